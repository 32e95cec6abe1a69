"""Structured Streaming: resumable deduplication, status upserts and batched loading over file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.contracts import checkpointed
from quern.sources.sinks import guard, mark, marked


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream of its files (the glob allows for both)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row of each key within the watermark; state older than ``delay`` is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n_rows"))


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a rerun goes on after the last committed batch."""
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_latest(stream: DataFrame, key: str, order: str, out: str, checkpoint: str, buckets: int = 64) -> None:
    """Keep the latest row of each key (largest ``order``, then the largest row) in a table of ``buckets`` folders at ``out``.

    A batch reads and rewrites only the buckets of its keys, by dynamic partition overwrite: bytes written are in proportion to what it
    touches. Taking the latest is the same however often a batch is applied, and an epoch whose marker is there is skipped, so replays and
    batches that stopped midway change nothing. The table belongs to its signature (key, order, buckets, columns): another one is an error.
    Null keys are one key. Read it with :func:`read_upserted`.
    """
    spark = stream.sparkSession
    guard(spark, f"{out}/signature.txt", key=key, order=order, buckets=buckets, columns=stream.schema.json())

    def merge(batch: DataFrame, epoch: int) -> None:
        if marked(spark, f"{out}/_epochs/{epoch}"):
            return
        named = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        newest = lambda rows: rows.groupBy("_bucket", F.col(key).alias("_k")).agg(F.max(F.struct(F.col(order).alias("_o"), F.struct(*batch.columns).alias("_r"))).alias("_m")).select("_m._r.*", "_bucket")
        fresh = checkpointed(newest(named))
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]
        if marked(spark, f"{out}/rows"):
            stored = spark.read.schema(fresh.schema).parquet(f"{out}/rows").where(F.col("_bucket").isin(touched))
            fresh = checkpointed(newest(fresh.unionByName(stored)))
        if touched:
            fresh.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{out}/rows")
        mark(spark, f"{out}/_epochs/{epoch}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_upserted(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/rows").drop("_bucket")
