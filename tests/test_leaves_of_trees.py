"""Leaves stay out of the rounds of the node walk; odd rows give what they gave: orphans, null keys, repeats, other types, hot parents."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import hierarchy
from tests.test_node_tables import plain, walked


def test_only_inner_nodes_take_part_in_the_rounds(spark, monkeypatch):
    counts, doubled = [], hierarchy._doubled
    monkeypatch.setattr(hierarchy, "_doubled", lambda state, n, step: counts.append(state.count()) or doubled(state, n, step))
    rows = [(0, None, 0), *[(i, 0, i) for i in range(1, 11)], *[(i, 1 + i % 5, i) for i in range(11, 400)]]
    assert walked(spark.createDataFrame(rows, "i long, p long, o int")) == plain(rows)
    assert counts == [6, 6]  # the root and five of its children


def test_a_hot_parent_of_leaves_and_inner_nodes(spark):
    rng = random.Random(5)
    rows = [(i, None if i < 3 else rng.choice([0, 0, 1, i // 3, 5_000]), rng.choice([None, 1, 2])) for i in range(600)]
    df = spark.createDataFrame([*rows, *rows[::4], *rows[:1] * 200, (None, 0, 1), (None, None, None)], "i long, p long, o int")
    assert walked(df.repartition(3)) == plain(rows)


@pytest.mark.parametrize("rows", [[(1, None, 0)], [(i, None, -i) for i in range(50)], [(i, 900 + i % 7, i % 3) for i in range(50)], [(3, 2, 0), (2, 1, 0), (1, 77, 0), (4, 2, 0)]])
def test_roots_and_orphans(spark, rows):
    assert walked(spark.createDataFrame(rows, "i long, p long, o int")) == plain(rows)


def test_parents_of_another_type(spark):
    rows = [(i, None if i == 0 else (i - 1) // 3, i) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, p long, o int")
    for kind in ("int", "string", "double"):
        assert walked(df.withColumn("p", F.col("p").cast(kind))) == plain(rows)
    found = hierarchy.walk_nodes(df.withColumn("p", F.col("p") + 0.5), "i", "p", "o")
    assert dict(found.dtypes)["parent_id"] == "bigint" and found.where("depth = 0").count() == 40
    assert walked(df.withColumn("p", F.lit(None))) == plain([(i, None, o) for i, _, o in rows])


def test_errors_are_kept(spark):
    for rows in ([(1, None, 0), (1, None, 1)], [(1, 8, 0), (1, 9, 0)], [(1, None, 0), (1, 2, 0), (2, None, 0)], [(1, 1, 0)], [(1, 3, 0), (2, 1, 0), (3, 2, 0), (4, 3, 0)]):
        with pytest.raises(ValueError):
            hierarchy.walk_nodes(spark.createDataFrame(rows, "i long, p long, o int"), "i", "p", "o")
