"""Secret scans over an incremental ledger of content-addressed text versions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import SMALL_ROWS, checkpointed

RULE_VERSION = "2024-1"
#: Kind, Java pattern, least length, whether the length is that of group 2; in the order of the report.
RULES = (
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, True),
    ("access", "AKIA[A-Z0-9]+", 18, False),
    ("hex", "[0-9a-f]{16,}", 16, False),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1, False),
    ("github", "gh[pousr]_[A-Za-z0-9]{30,}", 1, False),
    ("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", 1, False),
)
#: For masking, a private key with its body: all up to its END line, or without one the key lines that follow.
_PEM_BODY = (
    "(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    "|(?:(?:\\s|\\\\[nr])*+(?:(?:Proc-Type|DEK-Info):[^\n]*+|[A-Za-z0-9+/=]{16,}+)|[ \\t\r]*+\n[ \\t]*+[A-Za-z0-9+/=]++(?=[ \\t\r]*+(?:\n|\\z)))*+)"
)
MASK_RULES = tuple((name, pattern + _PEM_BODY if name == "pem" else pattern, *rest) for name, pattern, *rest in RULES)
MASK_RULE_VERSION = f"{RULE_VERSION}-mask"
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,kind:int,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"


def _lengths(text: Column, order: int, pattern: str, least: int, by_group: bool) -> Column:
    """For every leftmost non-overlapping match: the characters before it since the last, its own, and whether it counts.

    ``split`` and ``regexp_extract_all`` walk the same matches, so piece i precedes match i. Texts without a match stop at the first test.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("a"), found.alias("b"))
    ok = (lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= least) if by_group else (lambda m: F.length(m) >= least)
    one = lambda z, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), F.length(z["a"]).alias("a"), F.length(z["b"]).alias("b"), ok(z["b"]).alias("ok"))
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), F.transform(zipped, one)).otherwise(F.array().cast("array<struct<kind:int,i:int,a:int,b:int,ok:boolean>>"))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Findings of rows ``blob, text``: a row for each blob with any, ``blob, spans`` (start, kind's place in rules, end).

    Places are code points, spans are sorted by start, then kind. Places are running sums over a text's matches, so the cost is
    linear in them; what moves is a few numbers a match. A blob that comes twice is reported once.
    """
    kinds = F.concat(*[_lengths(F.col("text"), i, pattern, least, by_group) for i, (_, pattern, least, by_group) in enumerate(rules)])
    matches = blobs.select("blob", F.monotonically_increasing_id().alias("at"), kinds.alias("m")).where(F.size("m") > 0)
    matches = matches.select("blob", "at", F.explode("m").alias("m")).select("blob", "at", "m.*")
    run = Window.partitionBy("blob", "at", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = matches.withColumn("end", F.sum(F.col("a") + F.col("b")).over(run).cast("int")).where("ok")
    span = F.struct((F.col("end") - F.col("b")).alias("start"), "kind", "end")
    return placed.groupBy("blob").agg(F.array_sort(F.collect_set(span)).cast(SPANS).alias("spans"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept at ``path``; empty where none was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_ledger(spark)


def append_ledger(fresh: DataFrame, path: str) -> None:
    """Add the new rows to the ledger at ``path``; what is there is not written again."""
    fresh.select("blob", "rule_version", "spans").write.mode("append").parquet(path)


def secret_ledger(
    docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES, rule_version: str = RULE_VERSION, version_col: str | None = None, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scan only unseen (blob, rule version) pairs and join the findings back to every path.

    A blob is the SHA-256 of a whole text (null: the empty text); a path is a row of ``docs``, and with ``version_col`` every
    historical version of a path is a row with its own text. Of each blob that ``ledger`` lacks under ``rule_version`` one row is
    scanned. Most blobs have one path and are scanned where they are read: what is looked up is the table of
    exceptions, blobs that are known or have several paths, with the path that is picked. It is broadcast up to
    ``SMALL_ROWS`` rows; beyond that texts and exceptions meet by a sort-merge join. Findings join back by blob, broadcast if few.

    With ``path`` the ledger is read from there, and the new rows are appended to it before the findings are returned, so that the next run
    scans only what has changed since.

    Nulls and edge cases: null text is scanned as the empty one; a null path is a path; repeated rows
    share a blob and its findings; a pair that the ledger holds twice (two runs at once, a retried append) counts once; an empty table gives empty results; only the named columns are read.

    Returns (``doc_id, blob, spans`` for every row, after ``version`` if named; the ledger with the new rows).
    """
    spark = docs.sparkSession
    if path is not None:
        ledger = open_ledger(spark, path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    version = [F.col(version_col).alias("version")] if version_col else []
    versions = docs.select(F.col(id_col).cast("long").alias("doc_id"), *version, text.alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = checkpointed(versions.drop("text"))
    old = (ledger if ledger is not None else empty_ledger(spark)).where(F.col("rule_version") == rule_version)
    old = checkpointed(old.groupBy("blob").agg(F.max("spans").alias("spans"))) if ledger is not None else old.select("blob", "spans")
    key = F.xxhash64(*[c for c in paths.columns if c != "blob"])
    counted = paths.groupBy("blob").agg(F.min(key).alias("pick"), F.count("*").alias("n"))
    known = old.select("blob", F.lit(True).alias("known")) if ledger is not None else None
    marked = counted.join(known, "blob", "left") if known is not None else counted.withColumn("known", F.lit(None).cast("boolean"))
    marked = checkpointed(marked)
    unusual = marked.where("known OR n > 1").select("blob", "pick", F.coalesce("known", F.lit(False)).alias("known"))
    n_unusual = unusual.count()
    keyed = versions.select("blob", "text", key.alias("key"))
    met = keyed.join(F.broadcast(unusual) if n_unusual <= SMALL_ROWS else unusual.hint("merge"), "blob", "left")
    unseen = met.where("pick IS NULL OR (NOT known AND pick = key)").select("blob", "text")
    found = checkpointed(scan(unseen, rules))
    fresh = marked.where("known IS NULL").select("blob").join(found, "blob", "left")
    fresh = fresh.select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    if path is not None:
        fresh = checkpointed(fresh)
        append_ledger(fresh, path)
    hits = old.where(F.size("spans") > 0).unionByName(found)
    hits = hits if ledger is not None else found
    n_hits = hits.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]
    joined = paths.join(F.broadcast(hits) if n_hits <= SMALL_ROWS else hits, "blob", "left")
    joined = joined.select("doc_id", *(["version"] if version_col else []), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    full = fresh if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(fresh)
    return joined, full


def _joined(spans: Column, rules) -> Column:
    names = F.array(*[F.lit(r[0]) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(found: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """The digest of findings: counts of the base kinds, the checksum of the base spans, all spans as text."""
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{r[0]}") for k, r in enumerate(rules) if r[0] in base]
    own = [k for k, r in enumerate(rules) if r[0] in base]
    base_text = _joined(F.filter("spans", lambda s: s["kind"].isin(own)), rules)
    return found.select("doc_id", *counts, F.sha2(base_text, 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"))


def merged_runs(hits: DataFrame) -> DataFrame:
    """``blob, runs``: the spans of each blob with overlapping ones merged (start, end), by a running maximum of their ends."""
    spans = hits.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end", "s.kind")
    w = Window.partitionBy("blob").orderBy("start", "kind")
    last = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", (F.coalesce(F.col("start") >= last, F.lit(True))).cast("int"))
    run = opened.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = run.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def redact(text: Column, runs: Column, mask: str = "[SECRET]") -> Column:
    """The text with every run replaced by ``mask``.

    Four bytes a character make each piece a slice of known place, so the cost is linear in text and runs.
    """
    wide = F.encode(text, "UTF-32")
    piece = lambda a, b: F.decode(F.substring(wide, 4 * a + 1, 4 * (b - a)), "UTF-32")
    before = F.transform(runs, lambda r, i: piece(F.coalesce(F.get(runs, i - 1)["end"], F.lit(0)), r["start"]))
    tail = piece(F.element_at(runs, -1)["end"], F.length(text))
    return F.when(F.size(runs) > 0, F.concat(F.array_join(before, mask), F.lit(mask), tail)).otherwise(text)
