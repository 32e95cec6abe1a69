"""Connected components of an edge table by alternating star contraction; edges never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, right_sized


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node it reaches.

    Large-star then small-star per round: every node is hung below the smallest
    neighbour, and the edge table shrinks towards stars. Each star is a map-side
    combined minimum and one equi-join, whose hub keys adaptive execution may split.
    Rounds are cut by checkpoints; it ends when a round changes nothing.
    Null ends, self-loops and repeated edges are ignored. Returns ``node, component``
    for the nodes that have an edge; an empty table gives an empty result.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars, before = checkpointed(stars.distinct()), None
    for _ in range(max_rounds):
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        sized = lambda df: right_sized(df, 2 * before[0])
        stars = sized(stars)
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sized(both.groupBy("a").agg(F.min("b").alias("m"))).select("a", F.least("a", "m").alias("m"))
        large = sized(both.join(low, "a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = sized(large.distinct())
        low = sized(large.groupBy("a").agg(F.min("b").alias("m")))
        small = sized(large.join(low, "a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        stars = checkpointed(sized(small.distinct()))
    else:
        raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
