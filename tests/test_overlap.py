"""Pairs with common members against all pairs, with heavy members in cells."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quern.operators import joins


@pytest.mark.parametrize("least,cell_rows", [(1, 2_000), (1, 7), (2, 7), (3, 20)])
def test_pairs_equal_all_pairs(spark, least, cell_rows):
    rng = random.Random(least)
    rows = [(i, (["hot"] if i % 3 == 0 else []) + rng.choices("abcdefghijklmnop", k=rng.randint(0, 6)) + [None] * (i % 5 == 0)) for i in range(150)] + [(200, None), (None, ["hot", "a"])]
    df = spark.createDataFrame(rows, "i long, tags array<string>")
    sets = {i: {t for t in tags or () if t} for i, tags in rows if i is not None}
    want = {(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least}
    got = joins.sharing_pairs(df, "i", "tags", least, cell_rows).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_hot_member_is_cut_into_even_cells(spark):
    members = spark.range(9000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 40)).alias("_m"))
    left, right = joins.in_cells(members, "i", 200)
    for side, names in ((left, ["_m", "_i", "_j"]), (right, ["_n", "_k", "_l"])):
        sizes = sorted(r["count"] for r in side.groupBy(*names).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    hot = left.where("_m = 'hot'")
    assert hot.select("_i", "_j").distinct().count() == 15 * 16 // 2 and hot.select("i").distinct().count() == 3000


def test_pairs_are_not_shuffled(spark):
    """300 rows of two sets make 44,850 pairs; before, every shared member of every pair went through an exchange."""
    df = spark.range(300).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda x: x + F.col("id") % 2).alias("tags"))
    got = joins.sharing_pairs(df, "i", "tags", 2, 40)
    assert {tuple(r) for r in got.collect()} == {(a, b, 6 if (a - b) % 2 == 0 else 5) for a, b in combinations(range(300), 2)}
    assert got.count() == 300 * 299 // 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0] and plan.lstrip().startswith("MapInArrow")


def test_meetings_spread_over_tasks_however_small(spark):
    """Before, the meetings of blocks of a few KB were put together into one task, which then made all pairs."""
    df = spark.range(600).select(F.col("id").alias("i"), F.array(F.col("id") % 7, F.col("id") % 11).alias("tags"))
    got = joins.sharing_pairs(df, "i", "tags", 1, 60)
    made = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(made) >= 12 and max(made) < sum(made) / 4


@pytest.mark.parametrize("copies", [1, 20])
def test_pairs_of_copies_equal_all_pairs(spark, copies):
    tags = {i: {i % (400 // copies) % 9, 10 + i % (400 // copies) % 4} for i in range(400)}
    df = spark.createDataFrame([(i, sorted(t)) for i, t in tags.items()], "i long, tags array<long>")
    rows = joins.sharing_pairs(df, "i", "tags", 1, 100).collect()
    assert sorted(map(tuple, rows)) == [(a, b, len(tags[a] & tags[b])) for a, b in combinations(range(400), 2) if tags[a] & tags[b]]


def test_pairs_leave_in_runs_of_one_key(spark, tmp_path):
    """One column keeps its key for many rows, so files are small; before, the smaller key changed sides from row to row: 2.63 bytes a row."""
    tag = lambda x: F.pmod(F.xxhash64(F.col("id") * 10 + x), F.lit(97))
    df = spark.range(2000).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(4)), tag).alias("tags"))
    joins.sharing_pairs(df, "i", "tags").write.parquet(str(tmp_path / "pairs"))
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 2.1 * spark.read.parquet(str(tmp_path / "pairs")).count()
