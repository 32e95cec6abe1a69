"""Greedy one-to-one matching by rounds of locally best edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.contracts import checkpointed


def valid_candidates(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Finite values below 1 between two different, present ids."""
    v = F.col(value)
    return pairs.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v < 1.0) & F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))


def greedy_pairs(pairs: DataFrame, a: str, b: str, value: str, max_rounds: int | None = None) -> DataFrame:
    """What a scan by falling value that takes a pair if both ids are free would take.

    An edge that is best at both its ends is taken by that scan; such edges are taken together, edges of
    used ids go, and the rounds end when no edge is left. Each round is two map-side combined maxima and equi-joins.
    Ties go to the smaller (a, b). Every round takes the best open edge at least; with ``max_rounds``, edges open after so many raise.
    """
    edges = checkpointed(valid_candidates(pairs, a, b, value).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).alias("value")).distinct())
    taken = None
    order = F.struct(-F.col("value"), F.col("a"), F.col("b"))
    for round_ in count():
        ends = edges.select(F.col("a").alias("n"), order.alias("o")).unionByName(edges.select(F.col("b").alias("n"), order.alias("o")))
        best = ends.groupBy("n").agg(F.min("o").alias("o"))
        ba, bb = best.select(F.col("n").alias("a"), F.col("o").alias("oa")), best.select(F.col("n").alias("b"), F.col("o").alias("ob"))
        won = checkpointed(edges.join(ba, "a").join(bb, "b").where((F.col("oa") == order) & (F.col("ob") == order)).select("a", "b", "value"))
        if won.isEmpty():
            break
        if round_ == max_rounds:
            raise RuntimeError(f"open edges after {max_rounds} rounds")
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.col("a").alias("u")).unionByName(won.select(F.col("b").alias("u")))
        edges = checkpointed(edges.join(used, F.col("a") == F.col("u"), "left_anti").join(used, F.col("b") == F.col("u"), "left_anti"))
    return taken if taken is not None else edges.limit(0)
