"""Interaction of filters: what each of them removes, alone and behind the others, in every order of application."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filters of :func:`document_flags`, in the order of their bits.
FILTERS = ("A", "B", "C", "D", "E")


def word_totals(rows: DataFrame) -> DataFrame:
    """Words and distinct words of every (row_id, text_key) of ``rows(row_id, text_key, text)``.

    Texts are dealt once by their key, and both aggregates, by word and then by document, go on where the words are: exploded words
    are never shuffled. Each row adds one null to its words. The null's count is the number of rows that share the
    key, by which the total is divided, and it keeps the key of a text without words.
    """
    dealt = rows.select("row_id", "text_key", "text").repartition("row_id", "text_key")
    words = F.array_append(F.split("text", SPLIT), F.lit(None).cast("string"))
    exploded = dealt.select("row_id", "text_key", F.explode(words).alias("word")).where("word IS NULL OR word <> ''")
    by_word = exploded.groupBy("row_id", "text_key", "word").agg(F.count("*").alias("n"))
    totals = by_word.groupBy("row_id", "text_key").agg(
        F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("total"),
        F.count("word").alias("n_distinct"),
        F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("n_rows"),
    )
    return totals.select("row_id", "text_key", F.expr("coalesce(total, 0) div n_rows").alias("n_words"), "n_distinct")


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each document: ``part, mask, good, toxic``; bit k of ``mask`` is set where filter k of ``FILTERS`` fails.

    A: under 200 words; B: under half of the words distinct; C: over 2 % capital letters A-Z; D: a symbol of ``#$%&*|``; E: text
    identical to that of a document with a smaller id. ``good`` and ``toxic`` are whether ``labels`` has quality 1 and toxic 1.

    Words meet flags by outer joins on (id, 64-bit hash of the text). Two texts of one id would have to collide to be confused;
    copies for E are found by SHA-256. The table of copies holds one row for each text that two ids share; joins carry no hints,
    adaptive execution broadcasts by measured size or splits a hot text.

    Nulls and edge cases: null text is empty, a null part is the empty string; a null id is smaller or larger than none, so it neither
    fails E nor makes others fail; repeated rows count each; several labels of one id count as one that holds what any holds.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    base = base.withColumns({"row_id": F.coalesce("doc_id", F.lit(0)), "text_key": F.xxhash64("text", F.col("doc_id").isNull())})
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    slim = base.select(
        "row_id", "text_key", "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * capitals > 2 * F.length("text")).alias("c"), F.col("text").rlike(r"[#$%&*|]").alias("d"),
    )
    copies = slim.groupBy(F.col("digest").alias("copied")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    copies = copies.where("first_id < last_id").select("copied", "first_id")
    one = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(name)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(one("quality"), one("toxic"))
    met = slim.join(word_totals(base), ["row_id", "text_key"], "left")
    met = met.join(copies, F.col("digest") == F.col("copied"), "left").join(known, F.col("doc_id") == F.col("labelled"), "left")
    fails = {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": F.col("c"),
        "D": F.col("d"),
        "E": F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)),
    }
    mask = sum((F.when(fails[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    return met.select("part", mask.alias("mask"), F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def interaction_report(flags: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """Effect of every step of every order of ``filters`` in each part of ``flags(part, mask, good, toxic)``.

    Documents are aggregated to one row a part with conditional counts for each of the 2**k failure patterns (32 for five filters): of
    all, good and toxic documents. Everything else is a sum over the patterns of a row; k is at most 6.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; see
    :func:`filter_audit`. An empty table gives an empty result.
    """
    k = len(filters)
    if not 1 <= k <= 6:
        raise ValueError("between 1 and 6 filters")
    patterns = range(1 << k)
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.count_if((F.col("mask") == m) & kind).alias(f"{name}_{m}") for name, kind in kinds.items() for m in patterns]
    parts = flags.groupBy("part").agg(*counts)
    tally = F.array(*[F.struct(F.lit(m).alias("mask"), *[F.col(f"{name}_{m}").alias(name) for name in kinds]) for m in patterns])
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(f"('{''.join(filters[x] for x in order)}', {step}, {1 << f}, {before})")
            before |= 1 << f
    steps = F.expr(f"inline(array({', '.join(steps)}))").alias("filter_order", "step", "bit", "before")
    rows = parts.select("part", tally.alias("tally"), steps)
    bit, before = F.col("bit"), F.col("before")
    fails, passed = (lambda t: t["mask"].bitwiseAND(bit) != 0), (lambda t: t["mask"].bitwiseAND(before) == 0)

    def total(where, value=lambda t: t["n"]) -> Column:
        return F.aggregate("tally", F.lit(0).cast("long"), lambda found, t: found + F.when(where(t), value(t)).otherwise(F.lit(0).cast("long")))

    removed = lambda t: fails(t) & passed(t)
    first_in = lambda t: (t["n"] * F.lit(factorial(k)) / F.bit_count(t["mask"])).cast("long")
    share = lambda t: F.when(F.bit_count(t["mask"]) > 0, first_in(t)).otherwise(F.lit(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda t: ~fails(t) & passed(t)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda t: fails(t) & ~passed(t)).alias("redundant"),
        total(lambda t: t["mask"] == bit).alias("unique_fails"),
        total(removed, lambda t: t["good"]).alias("good_lost"),
        total(removed, lambda t: t["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Audit of the five filters of :func:`document_flags` over all their 120 orders, by part.

    For each part, order and step: documents ``kept`` after the step and ``removed`` by it; ``redundant``, failing the step's filter but
    removed before; ``unique_fails``, failing that filter alone; ``good_lost`` and ``toxic_lost``, labelled ones among those removed; and
    ``shapley``, what the filter removes over all orders. A document with c failures is removed by each of them in 1 / c of
    the orders, so ``shapley`` needs no pass over the orders.
    """
    return interaction_report(document_flags(docs, labels, **columns))
