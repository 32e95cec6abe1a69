"""Pruned neighbour search against the meeting of all blocks, on clustered vectors, ties, zero vectors and every metric."""

import random

import numpy as np
import pytest

from quern.operators import neighbors


def made(spark, n=2_000, clusters=40, dim=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % clusters]], f"c{i % clusters // 2}") for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(20)] + [(n + 20 + i, [0.0] * dim, "zero") for i in range(3)]
    rows += [(n + 30, None, "a"), (n + 31, [float("nan")] * dim, "a"), (None, rows[0][1], "a"), (n + 32, [2 * x for x in rows[5][1]], None)]
    return spark.createDataFrame(rows, "i long, v array<double>, t string")


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_pruned_rows_equal_all_meetings(spark, metric):
    df = made(spark)
    for rule in ("any", "other", "same") if metric == "cosine" else ("any",):
        meetings = []
        got = neighbors.knn(df, "i", "v", "t", 4, metric=metric, rule=rule, block_rows=50, meetings=meetings)
        want = neighbors.knn(df, "i", "v", "t", 4, metric=metric, rule=rule, block_rows=100_000)
        rows = [{(r.source_id, r.rank): (r.neighbour_id, round(r.value, 9)) for r in x.collect()} for x in (got, want)]
        assert rows[0] == rows[1]
        if rule == "any":
            assert sum(meetings) < (-(-2_024 // 50)) ** 2 / 4


def test_pruned_search_of_less_than_k_and_of_one_point(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], "t") for i in range(30)], "i long, v array<double>, t string")
    got = {(r.source_id, r.rank): r.neighbour_id for r in neighbors.knn(same, "i", "v", "t", 2, block_rows=7).collect()}
    assert got == {(i, r): ([0, 1, 2][r - 1] if i >= r else r) for i in range(30) for r in (1, 2)} | {(1, 1): 0, (1, 2): 2, (0, 1): 1, (0, 2): 2}
    few = spark.createDataFrame([(i, [float(i), 1.0], str(i % 3)) for i in range(9)], "i long, v array<double>, t string")
    assert neighbors.knn(few, "i", "v", "t", 5, rule="same", block_rows=2).count() == 9 * 2
    assert neighbors.knn(few.limit(0), "i", "v", "t", 5, block_rows=2).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_vectors_without_clusters_meet_in_a_fixed_number_of_stripes(spark, metric):
    """Each block is sent 16 times, however many there are; before, rows went to nearly every cell and blocks to every block."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], f"t{i % 3}") for i in range(600)]
    rows += [(600 + i, rows[7][1], "t1") for i in range(30)]
    df = spark.createDataFrame(rows, "i long, v array<double>, t string")
    meetings = []
    for rule in ("any", "other", "same"):
        got = neighbors.knn(df, "i", "v", "t", 4, metric=metric, rule=rule, block_rows=20, meetings=meetings)
        want = {}
        for a, v, t in rows:
            near = []
            for b, w, u in rows:
                if a != b and (rule == "any" or (t == u) == (rule == "same")):
                    if metric == "cosine":
                        near.append((-round(sum(x * y for x, y in zip(v, w)) / (sum(x * x for x in v) * sum(x * x for x in w)) ** 0.5, 11), b))
                    else:
                        p = 2 if metric == "euclidean" else 1
                        near.append((round(sum(abs(x - y) ** p for x, y in zip(v, w)) ** (1 / p), 11), b))
            want.update({(a, r + 1): b for r, (_, b) in enumerate(sorted(near)[:4])})
        assert {(r.source_id, r.rank): r.neighbour_id for r in got.collect()} == want
    assert not meetings and neighbors.MOST_STRIPES == 16


def test_pairs_within_meet_in_blocks(spark):
    """Pairs come from meetings of blocks; before, every pair's two vectors went through a row-wise join."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], "abc"[i % 3] if i % 11 else None) for i in range(120)] + [(200, None, "a"), (201, [1.0, None, 1.0, 1.0], "a"), (202, [1.0, 2.0], "a"), (203, [0.0] * 4, "b")]
    got = neighbors.pairs_within(spark.createDataFrame(rows, "i long, v array<double>, t string"), "i", "t", "v", block_rows=7)
    want = {}
    for a, v, t in rows:
        for b, w, u in rows:
            if a < b and t == u and t is not None:
                bad = v is None or w is None or None in v or None in w or len(v) != len(w)
                sizes = 0 if bad else (sum(x * x for x in v) * sum(x * x for x in w)) ** 0.5
                want[t, a, b] = None if bad else round(sum(x * y for x, y in zip(v, w)) / (sizes or 1), 9)
    assert {(r.t, r.a, r.b): None if r.cosine is None else round(r.cosine, 9) for r in got.collect()} == want
    assert "Join" in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1] and "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_within_leave_in_order_of_cosine(spark):
    """Equal rounded cosines stand together, so files are small; before, pairs left in the order of their ids."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], "t") for i in range(60)]
    got = neighbors.pairs_within(spark.createDataFrame(rows, "i long, v array<double>, t string"), "i", "t", "v").collect()
    assert len({(r.a, r.b) for r in got}) == len(got) == 60 * 59 // 2 and all(r.a < r.b for r in got)
    assert [r.cosine for r in got] == sorted(r.cosine for r in got)



def test_a_row_is_sent_as_often_however_many_rows_there_are(spark, monkeypatch):
    """Beyond one block, a row went to as many stripes as there were blocks, up to 16; and all rows met, where only those of its tag could be answers."""
    sent = []
    meetings = neighbors._meetings

    def counted(left, right, run, schema, numbers=None, least=neighbors.MOST_STRIPES):
        stripes = left.select("scope", "n_blocks", neighbors._stripes(left["n_blocks"], least).alias("n")).distinct().collect()
        sent.append({r.scope: r.n for r in stripes})
        return meetings(left, right, run, schema, numbers, least)

    monkeypatch.setattr(neighbors, "_meetings", counted)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], f"t{i % 3}" if i % 5 else None) for i in range(200)]
    for n in (60, 200):
        df = spark.createDataFrame(rows[:n], "i long, v array<double>, t string")
        for rule in ("other", "same"):
            got = {(r.source_id, r.rank): r.neighbour_id for r in neighbors.knn(df, "i", "v", "t", 2, rule=rule, block_rows=20).collect()}
            want = {(r.source_id, r.rank): r.neighbour_id for r in neighbors.knn(df, "i", "v", "t", 2, rule=rule, block_rows=1_000).collect()}
            assert got == want and len(got) == 2 * n
    assert [s for s in sent if "" in s] == [{"": 16}, {"": 1}] * 2 and [s for s in sent if "" not in s] == [dict.fromkeys(("t0", "t1", "t2", "\0"), 1)] * 4


@pytest.mark.parametrize("metric", ["cosine", "geodesic"])
def test_pair_sums_meet_once(spark, metric):
    """Two stripes met both ways, so that each pair was measured twice and a block went out twice as often."""
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], f"t{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, "i long, v array<double>, t string")
    got, want = ({r.source_id: r for r in neighbors.contrastive_sums(df, "i", "v", "t", 0.1, block_rows=size, metric=metric).collect()} for size in (7, 1_000))
    near = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for i, v, t in rows:
        assert got[i].n_positive == want[i].n_positive == 29 and got[i].n_negative == want[i].n_negative == 60
        assert all(abs(got[i][c] - want[i][c]) < 1e-9 for c in ("log_mass", "positive_sum", "negative_sum"))
        if metric == "cosine":
            assert abs(got[i].positive_sum - sum(near(v, w) for j, w, u in rows if u == t and j != i)) < 1e-9
    blocks = neighbors._blocks(neighbors._slim(df, "i", "v", "t", None)[0], 7)
    met = neighbors._meetings(blocks, blocks, lambda own, _, x, ids, *rest: [[int(own[0])], [int(ids[0])]], "a long, b long", once=True)
    assert met.count() == 16 * 17 // 2


def test_a_norm_is_computed_once_a_row(spark):
    """It stood within the function of the transform, so that each component had its own norm and time grew with the square of the length."""
    from quern.functions import vectors as V

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    for f, want in ((V.normalise, [[0.6, 0.8], [0.0, 0.0], None]), (V.exp_map, None)):
        got = df.select(f(df["v"]).alias("u"))
        assert got._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 1
        assert want is None or [r.u for r in got.collect()] == want


def test_zero_shot_is_one_product_a_batch(spark):
    """The classifier was read from JSON for each row, and each component of a row's scores had norms of its own."""
    from quern.operators import metrics

    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], "abc"[i % 3]) for i in range(40)] + [(50, None, "a"), (51, [1.0, None, 0.0, 0.0, 0.0], "b"), (52, [0.0] * 5, "c")]
    df = spark.createDataFrame(rows, "i long, v array<double>, t string")
    got = metrics.zero_shot(df, metrics.class_centroids(df.where("i < 40"), "t", "v", 5), "i", "v", "t")
    assert "from_json" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {}
    for r in got.collect():
        found.setdefault(r.i, []).append(r)
    assert {len(x) for x in found.values()} == {3} and len(found) == 43
    centre = {r.t: r.centroid for r in metrics.class_centroids(df.where("i < 40"), "t", "v", 5).collect()}
    for i, v, t in rows:
        ranked = sorted(found[i], key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == [1, 2, 3] and all(r.label == t for r in ranked)
        if i in (50, 51):
            assert [r["class"] for r in ranked] == ["a", "b", "c"] and all(r.logit is None and r.probability is None for r in ranked)
            continue
        size = sum(x * x for x in v) ** 0.5 or 1.0
        logits = {c: 100 * sum(x * y for x, y in zip(v, w)) / size for c, w in centre.items()}
        want = sorted(logits, key=lambda c: (-round(logits[c], 9), c))
        assert [r["class"] for r in ranked] == want and all(abs(r.logit - logits[r["class"]]) < 1e-9 for r in ranked)
        mass = {c: 2.718281828459045 ** (x - max(logits.values())) for c, x in logits.items()}
        assert all(abs(r.probability - mass[r["class"]] / sum(mass.values())) < 1e-9 for r in ranked)


def test_a_search_meets_two_stripes_once(spark):
    """two stripes met both ways, so that a row went out 32 times and not 17, and every pair was measured twice."""
    rng = random.Random(13)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], f"t{i % 3}") for i in range(150)] + [(150 + i, [1.0] * 6, "t1") for i in range(40)]
    df = spark.createDataFrame(rows, "i long, v array<double>, t string")
    blocks = neighbors._blocks(neighbors._slim(df, "i", "v", "t", None)[0], 10)
    assert neighbors._meetings(blocks, blocks, lambda own, _, x, ids, *rest: [[int(own[0])], [int(ids[0])]], "a long, b long").count() <= 16 * 17 // 2
    for metric in ("cosine", "euclidean", "manhattan", "geodesic"):
        for rule in ("any", "other"):
            got, want = ({(r.source_id, r.rank): (r.neighbour_id, round(r.value, 9)) for r in neighbors.knn(df, "i", "v", "t", 3, metric, rule, size).collect()} for size in (10, 1_000))
            assert got == want and len(got) == 3 * 190
    counts = {(r.source_id, r.rank): (r.neighbour_id, r.candidate_count) for r in neighbors.knn_in_scope(df.withColumn("s", df["i"] % 2), "i", "v", "t", "s", 2, block_rows=1).collect()}
    assert counts == {(r.source_id, r.rank): (r.neighbour_id, r.candidate_count) for r in neighbors.knn_in_scope(df.withColumn("s", df["i"] % 2), "i", "v", "t", "s", 2).collect()}


def test_edges_lose_no_neighbour(monkeypatch):
    """The best of either side, over many tiles and with hits measured early, against a sort of all distances; many equal vectors and ones of few bits."""
    monkeypatch.setattr(neighbors, "HITS", (50, 200))
    rng = np.random.default_rng(17)
    x, y = rng.integers(-2, 3, (2_300, 3)).astype(float), rng.normal(size=(1_500, 3))
    y[:700] = x[:700]
    own, ids = rng.permutation(4_000)[:2_300], 4_000 + rng.permutation(4_000)[:1_500]
    a, b = ([str(t) for t in rng.integers(0, 4, n)] for n in (2_300, 1_500))
    for rule in ("any", "other", "same"):
        found = neighbors._nearest(3, "euclidean", rule, False, True, True)(own, a, x, ids, b, y)
        far = np.round(np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)), 12)
        same = np.array(a)[:, None] == np.array(b)[None]
        allowed = {"any": np.ones_like(same), "other": ~same, "same": same}[rule]
        want = {}
        for mine, its, gap, may in ((own, ids, far, allowed), (ids, own, far.T, allowed.T)):
            for i, source in enumerate(mine):
                at = np.flatnonzero(may[i])
                want[int(source)] = ([int(v) for v in its[at[np.lexsort((its[at], gap[i][at]))[:3]]]], len(at))
        got = {}
        for s, j, _, n in zip(*found):
            neighbours, count = got.get(int(s), ([], 0))
            got[int(s)] = ([*neighbours, int(j)], count + int(n))
        assert got == want


def test_rows_that_share_one_of_several_tags_meet_by_tag(spark, monkeypatch):
    """F16: all rows met all, where only those that share a value could be answers; a pair that shares two counts once, null is a value, and an empty or null array has none."""
    scopes = []
    meetings = neighbors._meetings

    def seen(left, right, *rest, **named):
        scopes.append({r.scope for r in left.select("scope").distinct().collect()})
        return meetings(left, right, *rest, **named)

    monkeypatch.setattr(neighbors, "_meetings", seen)
    rng = random.Random(19)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], [i % 5, 10 + i % 5 // 2, 10 + i % 5 // 2] if i % 9 else [None, i % 7]) for i in range(120)]
    rows += [(120, rows[3][1], []), (121, rows[4][1], None), (122, rows[5][1], [99]), (123, None, [1])]
    near = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    def wanted(rows):
        want = {}
        for a, v, t in rows:
            found = sorted((-round(near(v, w), 11), b) for b, w, u in rows if v and w and a != b and set(t or []) & set(u or []))
            want.update({(a, r + 1): b for r, (_, b) in enumerate(found[:3])})
        return want

    kind = "i long, v array<double>, t array<int>"
    got = neighbors.knn(spark.createDataFrame(rows, kind), "i", "v", "t", 3, rule="same", block_rows=20)
    assert {(r.source_id, r.rank): r.neighbour_id for r in got.collect()} == wanted(rows)
    assert scopes.pop() == {*map(str, range(7)), "10", "11", "12", "99", "\0"}
    crowded = [(i, v, list(range(6))) for i, v, _ in rows[:60]]  # by tag, each pair would meet six times
    got = neighbors.knn(spark.createDataFrame(crowded, kind), "i", "v", "t", 3, rule="same", block_rows=20)
    assert {(r.source_id, r.rank): r.neighbour_id for r in got.collect()} == wanted(crowded) and scopes.pop() == {""}
