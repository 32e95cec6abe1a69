"""Checks at operator boundaries: columns at once, data as violations that a plan reports or raises."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def forbid_columns(df: DataFrame, *names: str) -> DataFrame:
    present = [n for n in names if n in df.columns]
    if present:
        raise ValueError(f"columns already present: {present}")
    return df


def raise_if(condition: Column, message: str, value: Column) -> Column:
    """``value``, or an error of the running job where ``condition`` holds."""
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def dependency_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value; empty if ``key -> value`` holds."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Multiset equality by two-way difference."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='quern-')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder in spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a folder of its own; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quern-ckpt-"))
    return df.checkpoint(eager=True)
