"""Trees as node tables against a plain walk: random forests, a long chain, a wide fan, orphans and cycles."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import hierarchy


def plain(rows):
    ids, kids, out = {i for i, *_ in rows}, {}, {}
    for i, p, o in rows:
        kids.setdefault(p if p in ids else None, []).append((o is not None, o or 0, i))
    stack, seen = [(i, None, 0, None) for *_, i in sorted(kids.get(None, []), reverse=True)], []
    while stack:
        i, p, depth, top = stack.pop()
        top = i if depth == 1 else top
        seen.append(i)
        out[i] = [p, depth, top, len(seen) - 1, 1]
        stack += [(c, i, depth + 1, top) for *_, c in sorted(kids.get(i, []), reverse=True)]
    for i in reversed(seen):
        if out[i][0] is not None:
            out[out[i][0]][4] += out[i][4]
    return {i: tuple(v) for i, v in out.items()}


def walked(df):
    return {r.id: (r.parent_id, r.depth, r.top_id, r.path, r.subtree_size) for r in hierarchy.walk_nodes(df, "i", "p", "o").collect()}


def test_forest_equals_a_plain_walk(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 999, 0, i // 2, i - 1, rng.randrange(i)]) if i else None, rng.choice([None, 1, 2, 3])) for i in range(120)]
    df = spark.createDataFrame([*rows, rows[5], (None, 3, 1)], "i long, p long, o int").withColumn("id", F.lit("other"))
    assert walked(df) == plain(rows)
    assert walked(df.limit(0)) == {}


def test_a_chain_and_a_fan(spark):
    n = 3_000
    chain = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"), F.lit(0).alias("o"))
    wrong = hierarchy.walk_nodes(chain, "i", "p", "o").where(f"depth <> id OR path <> id OR subtree_size <> {n} - id OR (id > 0 AND top_id <> 1)")
    assert wrong.count() == 0
    fan = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") > 0, F.lit(0).cast("long")).alias("p"), (-F.col("id")).alias("o"))
    wrong = hierarchy.walk_nodes(fan, "i", "p", "o").where(f"id > 0 AND (depth <> 1 OR path <> {n} - id OR subtree_size <> 1 OR top_id <> id)")
    assert wrong.count() == 0


def test_cycles_and_two_parents(spark):
    for rows in ([(1, 2, 0), (2, 1, 0), (3, None, 0)], [(1, None, 0), (2, 1, 0), (2, 3, 0), (3, 1, 0)]):
        with pytest.raises(ValueError):
            hierarchy.walk_nodes(spark.createDataFrame(rows, "i long, p long, o int"), "i", "p", "o")
