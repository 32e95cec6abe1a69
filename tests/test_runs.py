"""Runs over ranges against plain loops, with hot parts, nulls and runs across borders."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from quern.operators import windows


def test_runs_across_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), i, k) for i, k in enumerate(x for _ in range(60) for x in [rng.choice(["u", "v", None])] * rng.choice([1, 2, 40]))]
    df = spark.createDataFrame(rows, "p string, t long, k string").repartition(5)
    want, last, longest = [], set(), {}
    for p in ("hot", "b", None):
        own = [r for r in rows if r[0] == p]
        last.add(own[-1][1])
        number, bad, best = 0, 0, 0
        for k, run in groupby(own, key=lambda r: r[2]):
            run = list(run)
            for part in [run] if k is not None else [[r] for r in run]:
                number += 1
                want.append((p, number, k, part[0][1], part[-1][1], len(part)))
        for _, _, k in own:
            bad = bad + (k == "u") if k != "v" else 0
            best = max(best, bad)
        longest[p] = best
    got = windows.contiguous_runs(df, "p", "t", "k").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert {r.t for r in windows.last_flag(df, "p", "t").where("is_last").collect()} == last
    found = {r.p: r.longest_run for r in windows.longest_run(df.withColumn("bad", F.col("k") == "u"), "p", "t", "bad").collect()}
    assert {p: n for p, n in found.items() if p} == {p: n for p, n in longest.items() if p}
    assert windows.contiguous_runs(df.limit(0), "p", "t", "k").count() == 0
    sizes = windows.in_ranges(df, "p", "t").groupBy("_range").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) <= 2 * len(rows) / len(sizes)
