"""The corpus pipeline: quality rules, near-dedup, secret scan, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``. No stage has SQL, as robust estimates, MinHash and packing have none; the
tests hold each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import SMALL_ROWS, checkpointed, table
from quern.llm.mixing import mix_sources
from quern.llm.near_dedup import near_duplicates
from quern.llm.packing import best_fit_packing
from quern.llm.quality import quality_rules
from quern.llm.secrets import MASK_RULE_VERSION, MASK_RULES, merged_runs, redact, secret_ledger

ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their (language, source) go; the verdict stays with its row."""
    judged = quality_rules(docs, keep_cols=True).where("kept")
    return judged.select(*[F.col(f"_whole_row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id.

    A row is known by its id and its text: rows that share an id are judged each by its own text, equal ones count once, and a
    row without id takes part under an id made of its text, above all others.
    """
    text = F.coalesce("text", F.lit(""))
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2))
    keyed = docs.select(F.struct(*docs.columns).alias("_whole_row"), row_id.alias("row_id"), F.xxhash64(text).alias("text_key"))
    slim = docs.select(row_id.alias("row_id"), "text")
    judged = near_duplicates(slim, id_col="row_id", text_key=True)
    kept = judged.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    met = keyed.join(kept.hint("merge"), (F.col("row_id") == F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")))
    first = F.row_number().over(Window.partitionBy("row_id", "text_key").orderBy("row_id"))
    return met.withColumn("first", first).where("first = 1").select(*[F.col(f"_whole_row.`{c}`").alias(c) for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text, private keys with their bodies, becomes ``[SECRET]`` and ``n_chars`` follows; no document goes."""
    _, ledger = secret_ledger(docs, rules=MASK_RULES, rule_version=MASK_RULE_VERSION)
    hits = checkpointed(merged_runs(ledger.where(F.size("spans") > 0)).select(F.col("blob").alias("hit_blob"), "runs"))
    named = docs.select(F.struct(*docs.columns).alias("_whole_row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hit_key"))
    size = hits.agg(F.coalesce(F.sum(F.size("runs") + 1), F.lit(0))).first()[0]
    joined = named.join(F.broadcast(hits) if size <= SMALL_ROWS else hits, F.col("hit_key") == F.col("hit_blob"), "left")
    text = F.when(F.col("hit_blob").isNull(), F.col("_whole_row.text")).otherwise(redact(F.col("_whole_row.text"), F.col("runs")))
    kept = [F.col(f"_whole_row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    found = joined.select(*kept, text.alias("text"), F.col("_whole_row.n_chars").alias("old_chars"), F.col("hit_blob").isNotNull().alias("changed"))
    chars = F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("old_chars"))
    return found.withColumn("n_chars", chars).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: every document at least once, those of small sources up to 1.5 times on average."""
    return mix_sources(docs, repetitions=1.5, copy_col=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, with the ids of every piece."""
    return best_fit_packing(docs, with_ids=True)


STAGES = [
    ("quality rules", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("source mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
