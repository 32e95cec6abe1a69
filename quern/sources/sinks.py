"""Sinks: committed table writes, several outputs of one plan, metric appends, signed caches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; the committer makes the directory appear complete or not at all."""
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_captions(df: DataFrame, path: str, ok: str, image: str = "filepath", caption: str = "title") -> None:
    """The (title, filepath) table of the rows that succeeded, tab-separated with a header."""
    df.where(ok).select(F.col(caption).alias("title"), F.col(image).alias("filepath")).write.mode("overwrite").options(header=True, sep="\t", escape='"').csv(path)


def write_rows_and_counts(rows: DataFrame, counts: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    counts.write.mode("overwrite").parquet(f"{path}/counts")


def write_by(df: DataFrame, column: str, path: str) -> None:
    """One directory for each value; rows are gathered by value first, salted over 8 files so that a hot value spreads."""
    salted = df.repartition(F.col(column), F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    salted.write.mode("overwrite").partitionBy(column).parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def signature(**inputs) -> str:
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached_table(spark: SparkSession, root: str, build, **inputs) -> DataFrame:
    """The table of these inputs: read if it was written whole before (``_SUCCESS`` is there), else built and written."""
    path = f"{root}/{signature(**inputs)}"
    if not marked(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _file(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def marked(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    file, store = _file(spark, path)
    return store.exists(file)


def mark(spark: SparkSession, path: str, text: str = "") -> None:
    """A small file, replaced if it is there."""
    file, store = _file(spark, path)
    stream = store.create(file, True)
    stream.writeBytes(text)
    stream.close()


def guard(spark: SparkSession, path: str, **inputs) -> None:
    """Keep the signature of the inputs at ``path``; where another one is kept, it is an error to go on."""
    own = signature(**inputs)
    if not marked(spark, path):
        return mark(spark, path, own)
    kept = spark.read.text(path).first()
    if kept is None or kept[0] != own:
        raise ValueError(f"inputs differ from those that {path} was begun with")


def fingerprint(df: DataFrame, order: list[str] | None = None) -> str:
    """SHA-256 over the JSON records in the order of ``order`` (unique; by default of all columns), by a tree of digests.

    Each record has a SHA-256; records of one digest-prefix of their order key are hashed in order, then the prefixes' digests, 4,096 at
    most. So a changed, moved, lost or added record changes the result, and no task holds more than a share of the digests.
    """
    order = order or df.columns
    record = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    key = F.sha2(F.to_json(F.struct(*order), {"ignoreNullFields": "false"}), 256)
    parts = df.select(F.substring(key, 1, 3).alias("p"), F.struct(F.struct(*order).alias("o"), record.alias("h")).alias("x"))
    parts = parts.groupBy("p").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), ","), 256).alias("d"))
    whole = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ","), 256))
    return whole.first()[0]
