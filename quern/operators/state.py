"""Incremental scans, status folds and decision tables as joins of an old and a new state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.windows import longest_run  # noqa: F401  a fold over an ordered state


def incremental_scan(seen: DataFrame, state: DataFrame, path: str = "path", size: str = "size", mtime: str = "mtime", force: bool = False) -> DataFrame:
    """What a scan does with each path: ``reuse`` if size and time are as stored, ``recompute`` if they changed, ``new``, ``removed``."""
    old = state.select(F.col(path).alias("_p"), F.col(size).alias("_s"), F.col(mtime).alias("_m"), F.col("status").alias("old_status"))
    both = seen.select(path, size, mtime).join(old, F.col(path) == F.col("_p"), "full")
    same = (F.col(size) == F.col("_s")) & (F.col(mtime) == F.col("_m")) & F.lit(not force)
    action = F.when(F.col("_p").isNull(), "new").when(F.col(path).isNull(), "removed").when(same, "reuse").otherwise("recompute")
    return both.select(F.coalesce(path, "_p").alias(path), "old_status", action.alias("action"))


def next_state(scan: DataFrame, checked: DataFrame, path: str = "path") -> DataFrame:
    """State after a scan: reused statuses, fresh ones for what was checked, removed paths gone."""
    fresh = checked.select(F.col(path).alias("_p"), F.col("status").alias("_status"))
    joined = scan.where("action <> 'removed'").join(fresh, F.col(path) == F.col("_p"), "left")
    return joined.select(path, F.when(F.col("action") == "reuse", F.col("old_status")).otherwise(F.coalesce("_status", F.lit("pending"))).alias("status"))


def sync_decisions(source: DataFrame, target: DataFrame, path: str = "path", policy: str = "skip", compare: str = "size") -> DataFrame:
    """copied / existing / overwritten / skipped_conflict for every source path against the target tree.

    Files are the same by ``size`` alone, or by size with ``mtime`` or ``digest``. Where they differ, ``skip`` keeps the target, ``overwrite``
    takes the source, and ``newer`` takes it if its mtime is later.
    """
    if policy not in ("skip", "overwrite", "newer") or compare not in ("size", "mtime", "digest"):
        raise ValueError(f"unknown policy {policy} or comparison {compare}")
    used = dict.fromkeys(["size", *(["mtime"] if policy == "newer" else []), compare])
    there = target.select(F.col(path).alias("_p"), *[F.col(c).alias(f"_{c}") for c in used])
    same = (F.col("size") == F.col("_size")) & (F.col(compare) == F.col(f"_{compare}"))
    take = {"skip": F.lit(False), "overwrite": F.lit(True), "newer": F.col("mtime") > F.col("_mtime") if policy == "newer" else None}[policy]
    decision = F.when(F.col("_p").isNull(), "copied").when(same, "existing").when(take, "overwritten").otherwise("skipped_conflict")
    return source.join(there, F.col(path) == F.col("_p"), "left").select(path, "size", decision.alias("decision"))


def fallback_status(attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Fold attempts (key, origin, ok, error) into one status: the first origin of ``order`` that succeeded, else failed with all errors."""
    rank = F.coalesce(*[F.when(F.col("origin") == o, F.lit(i)) for i, o in enumerate(order)], F.lit(len(order)))
    good = F.min_by("origin", F.when(F.col("ok"), rank))
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct(rank.alias("r"), F.coalesce("error", F.lit("")).alias("e"))))), lambda s: s["e"]), " | ")
    grouped = attempts.groupBy(key).agg(good.alias("origin"), errors.alias("errors"))
    return grouped.select(key, F.coalesce("origin", F.lit("failed")).alias("status"), F.when(F.col("origin").isNull(), F.substring("errors", 1, 4000)).otherwise("").alias("error"))


def pending(rows: DataFrame, state: DataFrame, key: str, final: list[str]) -> DataFrame:
    """Rows whose state is not final yet."""
    return rows.join(state.where(F.col("status").isin(final)).select(key), key, "left_anti")


def first_pending(rows: DataFrame, state: DataFrame, key: str, order: str, final: list[str], n: int) -> DataFrame:
    """All rows of the first ``n`` distinct pending keys, by each key's first place in ``order``."""
    open_ = pending(rows, state, key, final)
    first = open_.groupBy(key).agg(F.min(order).alias("_first")).orderBy("_first", key).limit(n)
    return open_.join(first.select(key), key, "left_semi")


def with_file(rows: DataFrame, listing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Join rows to a file listing: present (best extension of ``order``, non-empty), empty or missing."""
    rank = F.coalesce(*[F.when(F.lower(F.col("ext")) == e, F.lit(i)) for i, e in enumerate(order)])
    files = listing.where(rank.isNotNull()).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by("path", F.when(F.col("size") > 0, rank)).alias("file"), F.count("*").alias("_n"))
    joined = rows.join(files, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    status = F.when(F.col("file").isNotNull(), "present").when(F.col("_n").isNotNull(), "empty").otherwise("missing")
    return joined.select(*rows.columns, "file", status.alias("file_status"))
