"""Grouped aggregation: aligned arrays, text policies, sets, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned_arrays(rows: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """Distinct (label, name) of each key as two arrays in (label, name) order."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(label).alias("label"), F.col(name).alias("name"))))
    grouped = rows.groupBy(key).agg(pairs.alias("_p"))
    return grouped.select(key, F.transform("_p", lambda p: p["label"]).alias("labels"), F.transform("_p", lambda p: p["name"]).alias("names"))


def one_text(rows: DataFrame, key: str, text: str, order: str, policy: str = "longest") -> DataFrame:
    """One text for each key: ``first`` by order, ``longest`` (earliest of equals), or ``error`` if texts differ."""
    if policy == "first":
        value = F.min_by(text, order)
    elif policy == "longest":
        value = F.max_by(text, F.struct(F.length(text), -F.col(order)))
    elif policy == "error":
        value = F.when(F.count_distinct(F.col(text)) > 1, F.raise_error(F.lit("texts differ"))).otherwise(F.min(text))
    else:
        raise ValueError(policy)
    return rows.where(F.trim(text) != "").groupBy(key).agg(value.alias(text))


def first_filled(rows: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """Count of rows and the first non-blank value of each column."""
    firsts = [F.min_by(v, F.when(F.trim(v) != "", F.col(order))).alias(v) for v in values]
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), *firsts)


def union_sets(rows: DataFrame, key: str, values: list[str], separator: str = ";") -> DataFrame:
    return rows.groupBy(key).agg(*[F.array_join(F.array_sort(F.collect_set(v)), separator).alias(v) for v in values])


def counts_with_total(rows: DataFrame, keys: list[str], total: str = "__ALL__") -> DataFrame:
    """Counts of each key combination and of all rows, by one rollup."""
    whole = F.grouping_id() == (1 << len(keys)) - 1
    rolled = rows.rollup(*keys).agg(F.count("*").alias("n_rows"), F.grouping_id().alias("_g"), whole.alias("_all"))
    rolled = rolled.where((F.col("_g") == 0) | F.col("_all"))
    return rolled.select(*[F.when(F.col("_all"), F.lit(total)).otherwise(F.col(k).cast("string")).alias(k) for k in keys], "n_rows")


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean of batch metrics weighted by batch size; partial sums merge in any order."""
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def smallest_path(rows: DataFrame, key: str, path: str) -> DataFrame:
    """One path for each key, least by lower case, and how many others there were."""
    return rows.groupBy(key).agg(F.min_by(path, F.struct(F.lower(path), F.col(path))).alias(path), (F.count("*") - 1).alias("n_others"))


def first_occurrence_codes(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in order of first occurrence, numbered from 0."""
    from quern.operators.windows import with_row_number

    firsts = rows.groupBy(key).agg(F.min(order).alias("first_at"))
    return with_row_number(firsts, "first_at", [key]).select(key, "first_at", (F.col("row_number") - 1).alias("code"))


def priority_values(rows: DataFrame, key: str, value: str, priority: str) -> DataFrame:
    """Distinct values of each key, each at its best priority, in that order."""
    best = rows.where(F.trim(value) != "").groupBy(key, value).agg(F.min(priority).alias("_p"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_p"), F.col(value).alias("v"))))
    return best.groupBy(key).agg(F.transform(ordered, lambda s: s["v"]).alias("choices"))
