"""Word windows, ball-tree clusters and the filter audit against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.audit import filter_audit
from quern.llm.clusters import ball_tree_clusters, build_tree, exact_distances
from quern.llm.debruijn import compacted_paths, remove_repeated_windows, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_order(rows):
    """Documents as (id, words) in the order that decides which window is first."""
    docs = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    tie = lambda ws: int.from_bytes(hashlib.blake2b("".join(f"{w} " for w in ws).encode(), digest_size=4).digest(), "little", signed=True)
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, tie(d[1])))


def plain_windows(rows, k):
    seen, out = set(), []
    for doc, words in in_order(rows):
        gone = set()
        for i in range(len(words) - k + 1):
            window = tuple(words[i : i + k])
            if window in seen:
                gone.update(range(i, i + k))
            seen.add(window)
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def plain_paths(rows, k):
    """Occurrences (id, start, words) of maximal paths whose windows all occur together, by following neighbours."""
    docs = in_order(rows)
    places = defaultdict(list)
    for d, (_, words) in enumerate(docs):
        for i in range(len(words) - k + 1):
            places[tuple(words[i : i + k])].append((d, i))
    window = lambda d, i: tuple(docs[d][1][i : i + k]) if 0 <= i <= len(docs[d][1]) - k else None
    near = lambda w, step: {x if x and len(places[x]) > 1 else (d, i) for d, i in places[w] for x in [window(d, i + step)]}
    linked = lambda a, b: b is not None and len(places.get(b, ())) > 1 and near(a, 1) == {b} and near(b, -1) == {a}
    found = []
    for w, at in places.items():
        if len(at) < 2:
            continue
        for d, i in at:
            if not (i and window(d, i - 1) in places and len(places[window(d, i - 1)]) > 1 and linked(window(d, i - 1), w)):
                n = 1
                while linked(window(d, i + n - 1), window(d, i + n)):
                    n += 1
                found.append((docs[d][0], i, " ".join(docs[d][1][i : i + n + k - 1])))
    return sorted(found, key=str)


def passages():
    rng = random.Random(11)
    letters = lambda n: [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)]
    shared = [letters(30) for _ in range(6)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(shared)) if rng.random() < 0.6 else letters(rng.randint(1, 20))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "odd"
            words += part[rng.choice([0, 0, 5]) :]
        rows.append((i * 7 % 41, rng.choice([" ", "\n", "  \t"]).join(words), "en", "web"))
    rows += [(50, "la " * 40, "en", "web"), (51, "la la " * 3 + "li lo " * 12, "en", "web"), (51, "la " * 9, "en", "web"), (51, "la " * 9, "en", "web"), (None, rows[3][1], None, None), (52, None, None, None)]
    return rows


@pytest.mark.parametrize("options", [{}, {"bits": 9}, {"side_bytes": 200}, {"bits": 8, "side_bytes": 300}])
def test_windows_equal_brute_force(frame, options):
    rows = passages()
    got = remove_repeated_windows(frame(rows).repartition(5), window=5, **options).collect()
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=str) == sorted(plain_windows(rows, 5), key=str)


def test_windows_of_made_documents_and_digest(docs, rows):
    got = remove_repeated_windows(docs, digest=True, side_bytes=20_000).collect()
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in plain_windows(rows, 20)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert any(m for _, _, m, _ in want)


@pytest.mark.parametrize("bits", [64, 10])
def test_paths_are_compacted_and_whole(frame, bits):
    rows = passages()
    got = compacted_paths(frame(rows).repartition(3), window=5, bits=bits).collect()
    words = {r[0]: WORD.findall(r[1] or "") for r in rows if r[0] != 51}
    by_path = defaultdict(set)
    for r in got:
        if r["doc_id"] != 51:
            by_path[r["path"]].add(tuple(words[r["doc_id"]][r["start"] : r["start"] + r["n_words"]]))
    assert all(len(x) == 1 for x in by_path.values())
    firsts = defaultdict(int)
    for r in got:
        firsts[r["path"]] += r["first"]
    assert set(firsts.values()) == {1} and all(r["n_found"] > 1 for r in got)
    if bits == 64:
        want = plain_paths(rows, 5)
        assert sorted(((r["doc_id"], r["start"], r["n_words"]) for r in got), key=str) == sorted(((d, i, len(t.split(" "))) for d, i, t in want), key=str)


def test_windows_of_nothing_and_of_long_texts(frame, empty):
    assert remove_repeated_windows(empty).count() == 0 and compacted_paths(empty).count() == 0
    long_ = " ".join(f"w{i % 7919}" for i in range(60_000))
    got = {r[0]: r[1:3] for r in remove_repeated_windows(frame([(1, long_, None, None), (2, long_, None, None), (3, "short", None, None)])).collect()}
    assert got == {1: (60_000, 60_000 - 7919), 2: (60_000, 60_000), 3: (1, 0)}


def test_window_hashes_follow_words():
    words = np.random.default_rng(0).integers(0, 5, 400).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 20, 21):
        by_window = defaultdict(set)
        for i, h in enumerate(window_hashes(words, k).tolist()):
            by_window[tuple(words[i : i + k].tolist())].add(h)
        assert len(by_window) == len(set.union(*by_window.values())) and all(len(x) == 1 for x in by_window.values())
    assert len(window_hashes(words[:4], 5)) == 0


def plain_clusters(rows, dims, k, rounds):
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for c in set(of):
            own = [v for (_, v), x in zip(kept, of) if x == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    of = assign()
    distance = [far(v, centroids[c]) for (_, v), c in zip(kept, of)]
    inertia = defaultdict(int)
    for c, d in zip(of, distance):
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(distance), names[c]) for (i, _), c, d in zip(kept, of, distance)), key=str)


@pytest.mark.parametrize("spread", [0.001, 0.5, 30_000.0])
def test_clusters_equal_brute_force(spark, spread):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(5, 4)) * max(1, spread)
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.normal(size=4) * spread * 0.2).astype(np.float32)]) for i in range(400)]
    rows += [rows[3], rows[3], (None, rows[5][1]), (900, None), (901, [1.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [float("inf")] * 4), (904, [None, 1.0, 1.0, 1.0])]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in ("id", "vector", "cluster", "distance", "n")}).repartition(3)
    stats = []
    got = ball_tree_clusters(df, dims=4, rounds=6, block_rows=64, leaf=4, stats=stats).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows, 4, 8, 6)
    assert all(n == len(got) and compared < n for n, compared in stats)


def test_clusters_of_few_vectors_and_far_ones(spark):
    schema = "vec_id long, embedding array<double>"
    few = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [4.0, -3.5])]
    got = ball_tree_clusters(spark.createDataFrame(few, schema), dims=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(few, 2, 8, 10)
    assert ball_tree_clusters(spark.createDataFrame([(1, None)], schema), dims=2).count() == 0
    with pytest.raises(Exception, match="out of range"):
        ball_tree_clusters(spark.createDataFrame([(1, [1e9, 0.0])], schema), dims=2).collect()


def test_tree_balls_hold_their_points():
    points = np.random.default_rng(5).integers(-3000, 3000, (500, 6))
    order, nodes, sums, radii = build_tree(points, 16)
    assert sorted(order.tolist()) == list(range(500))
    for (start, end, parent), total, radius in zip(nodes.tolist(), sums, radii):
        own = points[order[start:end]]
        assert (own.sum(axis=0) == total).all() and np.sqrt(((own - total / len(own)) ** 2).sum(axis=1)).max() <= radius
        assert parent < 0 or nodes["start"][parent] <= start < end <= nodes["end"][parent]
    wide = points.astype(np.int64) * 20_000
    assert (exact_distances(wide, wide[:3]) == ((wide[:, None, :] - wide[None, :3, :]) ** 2).sum(axis=2)).all()


def plain_audit(rows, labels):
    fails = []
    for doc, text, _, source in rows:
        text = text or ""
        words = WORD.findall(text)
        e = doc is not None and any((t or "") == text and i is not None and i < doc for i, t, _, _ in rows)
        capitals = sum("A" <= c <= "Z" for c in text)
        flags = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), bool(set(text) & set("#$%&*|")), e)
        own = [x for x in labels if doc is not None and x[0] == doc]
        fails.append((source or "", {f for f, x in zip("ABCDE", flags) if x}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {x[0] for x in fails}:
        own, removed_by, steps = [x for x in fails if x[0] == part], defaultdict(int), []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                removed = [x for x in own if f in x[1] and not x[1] & set(order[:k])]
                removed_by[f] += len(removed)
                steps.append(("".join(order), k + 1, f, sum(not x[1] & set(order[: k + 1]) for x in own), removed, sum(f in x[1] and bool(x[1] & set(order[:k])) for x in own)))
        for order, step, f, kept, removed, redundant in steps:
            out.append((part, order, step, kept, len(removed), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed), removed_by[f]))
    return sorted(out)


def test_audit_equals_brute_force(spark, docs, rows):
    rng = random.Random(13)
    more = [(200 + i, " ".join(rng.choice(["aa", "bb", "Cc", "d#", "éé"]) + rng.choice(["", str(i), str(rng.random())]) for _ in range(rng.randint(0, 400))), None, rng.choice(["", None, "book"])) for i in range(30)]
    frame = spark.createDataFrame(more, "doc_id long, text string, lang string, source string")
    both = docs.unionByName(frame, allowMissingColumns=True)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 230, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got = filter_audit(both, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(r) for r in got) == plain_audit([*rows, *more], labels)


def test_audit_of_nothing(spark, empty):
    assert filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
