"""Temperature mixing of sources: bisect the exponent, then realise the weights as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, join_small


def tempered(tokens: dict, alpha: float) -> dict:
    """Weights proportional to share ** alpha, normalised."""
    total = float(sum(tokens.values()))
    raw = {s: (n / total) ** alpha for s, n in tokens.items() if n > 0}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def bisect_exponent(tokens: dict, entropy: float = 0.95, repetitions: float = 2.0, budget: float | None = None, rounds: int = 60) -> tuple[float, dict, float]:
    """The largest exponent in [0, 1] whose weights have at least ``entropy`` of the largest entropy, raised until no source
    is repeated more than ``repetitions`` times; the repetition limit wins. Returns (exponent, weights, budget in tokens).

    Without ``budget`` it is the least that passes every source once: nothing is left out, smaller sources repeat.
    Entropy falls and repetition falls as the exponent grows, so both bounds are found by bisection.
    """
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return 1.0, {}, 0.0

    def plan(alpha):
        weights = tempered(tokens, alpha)
        size = budget if budget is not None else max(tokens[s] / w for s, w in weights.items())
        return weights, size

    def flat(alpha):
        weights = plan(alpha)[0]
        return -sum(w * math.log(w) for w in weights.values()) >= entropy * math.log(max(len(weights), 2)) - 1e-12

    def within(alpha):
        weights, size = plan(alpha)
        return max(size * w / tokens[s] for s, w in weights.items()) <= repetitions + 1e-9

    def edge(holds_low, test):
        """The exponent where ``test`` changes; it holds below if holds_low, else above."""
        low, high = 0.0, 1.0
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (mid, high) if test(mid) == holds_low else (low, mid)
        return low if holds_low else high

    alpha = 1.0 if flat(1.0) else edge(True, flat)
    if not within(alpha):
        alpha = max(alpha, edge(False, within) if within(1.0) else 1.0)
    weights, size = plan(alpha)
    return alpha, weights, size


def search_exponent(totals: DataFrame, entropy: float = 0.95, repetitions: float = 2.0, budget: float | None = None, width: int = 64, rounds: int = 5) -> tuple[float, float, float]:
    """:func:`bisect_exponent` over a table of sources (``t``: tokens, over 0): exponent, sum of share ** exponent, budget.

    Every round cuts the interval in ``width`` parts by one aggregate over the sources; what reaches the driver is a row for each
    exponent tried, however many sources there are. The last round leaves an interval of width ** -rounds.
    """
    head = totals.agg(F.count("*").alias("n"), F.sum("t").alias("total"), F.min("t").alias("low"), F.max("t").alias("high")).first()
    if not head.n:
        return 1.0, 0.0, 0.0
    total, low, high = float(head.total), head.low / head.total, head.high / head.total

    def sums(alphas):
        """For each exponent: sum of p ** a, and the entropy of the weights p ** a / sum."""
        p = F.col("t") / F.lit(total)
        rows = totals.select(p.alias("p"), F.explode(F.array(*map(F.lit, alphas))).alias("a")).groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("l")).collect()
        return {r.a: (r.z, math.log(r.z) - r.a * r.l / r.z) for r in rows}

    def size(a, z):
        return budget if budget is not None else total * z * high ** (1 - a)

    flat = lambda a, z, h: h >= entropy * math.log(max(head.n, 2)) - 1e-12
    within = lambda a, z, h: size(a, z) / z / total * low ** (a - 1) <= repetitions + 1e-9

    def edge(holds_low, test):
        a, b = 0.0, 1.0
        for _ in range(rounds):
            grid = [a + (b - a) * i / width for i in range(1, width)]
            found = sums(grid)
            holds = [test(x, *found[x]) for x in grid]
            k = sum(holds) if holds_low else len(grid) - sum(holds)
            a, b = ([a, *grid, b])[k : k + 2]
        return a if holds_low else b

    ends = sums([0.0, 1.0])
    alpha = 1.0 if flat(1.0, *ends[1.0]) else edge(True, flat)
    z, h = sums([alpha])[alpha]
    if not within(alpha, z, h):
        alpha = max(alpha, edge(False, within) if within(1.0, *ends[1.0]) else 1.0)
        z, h = sums([alpha])[alpha]
    return alpha, z, size(alpha, z)


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def word_count(text_col: str = "text") -> Column:
    """Words of the text, one at least: what mixing takes for tokens."""
    return F.greatest(F.regexp_count(_text(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1)).cast("long")


def mixing_cuts(slim: DataFrame, entropy: float, repetitions: float, budget: float | None, block_rows: int | None, seed: int) -> tuple[DataFrame, int]:
    """For every source of ``slim(s, k, t)``: whole passes, and the place (block hash, block, k) where the next pass ends.

    Returns the table of cuts (one row a source) and its size.
    """
    totals = checkpointed(slim.groupBy("s").agg(F.sum("t").alias("t"), F.count("*").alias("n")))
    found = totals.agg(F.count("*"), F.sum("t"), F.sum("n")).first()
    n_sources, total, n_rows = found[0], float(found[1] or 1), found[2] or 0
    alpha, z, size = search_exponent(totals, entropy, repetitions, budget)
    block_rows = block_rows or max(1_000, math.isqrt(n_rows))
    want = F.lit(size) * F.pow(F.col("t") / F.lit(total), F.lit(alpha)) / F.lit(z)
    plan = totals.withColumn("want", want).withColumn("full", F.floor(F.col("want") / F.col("t") + 1e-9).cast("int"))
    rest = F.greatest(F.col("want") - F.col("full") * F.col("t"), F.lit(0.0))
    plan = plan.select("s", "full", F.when(rest > 1e-6 * F.col("t"), rest).otherwise(0.0).alias("rest"), F.greatest(F.ceil(F.col("n") / block_rows), F.lit(1)).alias("blocks"))
    plan = checkpointed(plan)
    placed = join_small(slim, plan, ["s"], n_sources).withColumn("block", F.pmod(F.xxhash64("k", F.lit(1)), F.col("blocks")))
    turn = block_turn(seed)
    sums = placed.where("rest > 0").groupBy("s", "block").agg(F.sum("t").alias("bt"), F.first("rest").alias("rest")).withColumn("turn", turn)
    order = Window.partitionBy("s").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    crossed = sums.withColumn("before", F.coalesce(F.sum("bt").over(order), F.lit(0))).where("before < rest AND rest <= before + bt")
    crossed = checkpointed(crossed.select("s", "block", "turn", F.col("rest") - F.col("before")).toDF("s", "cut_block", "cut_turn", "room"))
    inside = join_small(placed.select("s", "k", "t", "block"), crossed, ["s"], n_sources).where("block = cut_block")
    inside = inside.groupBy("s", "k").agg(F.sum("t").alias("t"), F.first("room").alias("room"))
    run = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("run", F.coalesce(F.sum("t").over(run), F.lit(0))).where("run < room").groupBy("s").agg(F.max("k").alias("cut_k"))
    cuts = plan.join(crossed.drop("room"), "s", "left").join(taken, "s", "left")
    return checkpointed(cuts.select("s", "full", "blocks", "cut_turn", "cut_block", "cut_k")), n_sources


def block_turn(seed: int) -> Column:
    """A block's turn in the random order of its source's blocks."""
    return F.xxhash64(F.lit(seed), "s", "block")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = 0.95, repetitions: float = 2.0, budget: float | None = None, block_rows: int | None = None, seed: int = 29, copy_col: str | None = "mix_copy", tokens: Column | None = None, order_cols: bool = False
) -> DataFrame:
    """The rows of ``docs``, repeated or left out so that each source supplies its tempered share of the token budget.

    A document's tokens are its words, one at least, or ``tokens``. Token totals per source decide the exponent
    (:func:`search_exponent`) and each source's budget. A source's rows are hashed to blocks of about ``block_rows`` (by default
    the root of the row count, 1,000 at least); blocks stand in a seeded random order and rows in a random order within each. A source
    is passed whole as often as its budget holds, then once more in that order up to the row that crosses the rest of the
    budget. So a source's plan is one row: whole passes and the place where the last one ends. Running totals go
    over the blocks of a source and over the rows of the one block that is cut, both about the root of the rows, and
    whole rows meet nothing but the plan: no text is shuffled and no source meets in one task.

    Nulls and edge cases: a null source is a source of its own; null or blank text counts one token; a null id is hashed by text;
    repeated rows are rows, with one decision; an empty table gives an empty result. The columns of ``docs`` stay as they are, also those
    named like the operator's own.

    Returns the columns of ``docs`` and, if named, ``copy_col`` (int, from 0); with ``order_cols`` also ``mix_block, mix_key``:
    sorted by copy, block and key, each source is the permutation that was cut.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole_row"), *([tokens.alias("_t")] if tokens is not None else []))
    text = f"_whole_row.`{text_col}`"
    source = F.coalesce(F.concat(F.lit("="), F.col(f"_whole_row.`{source_col}`").cast("string")), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(f"_whole_row.`{id_col}`").cast("string"), F.lit("")), F.crc32(_text(text)))
    slim = checkpointed(keyed.select(source.alias("s"), key.alias("k"), (word_count(text) if tokens is None else F.col("_t")).alias("t")))
    cuts, n_sources = mixing_cuts(slim, entropy, repetitions, budget, block_rows, seed)
    placed = join_small(keyed.select("_whole_row", key.alias("k"), source.alias("s")), cuts, ["s"], n_sources)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("k", F.lit(1)), F.col("blocks"))).withColumn("turn", block_turn(seed))
    ahead = F.struct("turn", "block", "k") <= F.struct(F.col("cut_turn"), F.col("cut_block"), F.col("cut_k"))
    copies = F.col("full") + F.when(F.col("cut_turn").isNotNull(), ahead).otherwise(False).cast("int")
    out = placed.withColumn("copies", copies).where("copies > 0").select("_whole_row", "turn", "k", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_copy"))
    own = [F.col(f"_whole_row.`{c}`").alias(c) for c in docs.columns]
    order = [F.col("turn").alias("mix_block"), F.col("k").alias("mix_key")] if order_cols else []
    return out.select(*own, *([F.col("_copy").alias(copy_col)] if copy_col else []), *order)


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """:func:`mix_sources` without the texts, which are read once for their word counts and checksums.

    Returns ``doc_id, source, n_tokens`` (words, one at least), ``mix_copy, mix_block, mix_key``.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.crc32(_text(text_col)).cast("string").alias("text"), word_count(text_col).alias("n_tokens"))
    own = checkpointed(own)
    return mix_sources(own, tokens=F.col("n_tokens"), order_cols=True, **settings).select("doc_id", "source", "n_tokens", "mix_copy", "mix_block", "mix_key")
