"""Operators that SQL does not express, and rules at the borders: errors, blanks, ties, files."""

import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from quern import contracts
from quern.functions import nested, text, vectors
from quern.operators import aggregates, hierarchy, joins, matching, metrics, neighbors, sampling, splits, state, windows
from quern.sources import readers, sinks
from quern.streaming import incremental


def test_fanout_blanks_and_errors(spark):
    left = spark.createDataFrame([("a",), (" b ",), ("c",)], "id string")
    right = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "id string, caption string")
    got = sorted(map(tuple, joins.left_fanout(left, right, "id", ["caption"]).collect()))
    assert got == [(" b ", ""), ("a", "x"), ("a", "y"), ("c", "")]
    with pytest.raises(Exception, match="blank id"):
        joins.left_fanout(left, spark.createDataFrame([(" ", "x")], right.schema), "id", ["caption"]).collect()
    with pytest.raises(ValueError):
        joins.left_fanout(left.withColumn("caption", F.lit("")), right, "id", ["caption"])


def test_strict_lookup_reports_misses_and_conflicts(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, name string")
    assert {r.name for r in joins.strict_lookup(left, dim, "k", ["name"]).collect()} == {"a", "b"}
    with pytest.raises(Exception, match="not found"):
        joins.strict_lookup(left, dim.where("k = 1"), "k", ["name"]).collect()
    with pytest.raises(Exception, match="conflicting"):
        joins.strict_lookup(left, dim.unionByName(spark.createDataFrame([(1, "z")], dim.schema)), "k", ["name"]).collect()


def test_text_policy(spark):
    rows = spark.createDataFrame([("a", "long one", 2), ("a", "equal ok", 1), ("a", " ", 0)], "k string, t string, n int")
    assert aggregates.one_text(rows, "k", "t", "n", "longest").first().t == "equal ok"
    assert aggregates.one_text(rows, "k", "t", "n", "first").first().t == "equal ok"
    with pytest.raises(Exception, match="differ"):
        aggregates.one_text(rows, "k", "t", "n", "error").collect()


def test_row_numbers_without_one_sorting_task(spark):
    values = [random.Random(1).randint(0, 50) for _ in range(500)] + [None, None]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(5)
    got = {r.id: r.row_number for r in windows.with_row_number(df, "v", ["id"], parts=7).collect()}
    want = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert [got[i] for i in want] == list(range(1, len(values) + 1))


def test_epoch_sizes():
    assert windows.epoch_sizes(1000, 10, 4, 3) == {"num_batches": 27, "num_samples": 1080, "per_worker": 9}
    assert windows.epoch_sizes(1000, 10, 4, 3, round_up=False)["num_batches"] == 27


TREE = """{"LabelName": "root", "Subcategory": [
  {"LabelName": "/m/a", "TextName": "A", "Subcategory": [{"LabelName": "/m/x", "TextName": "X:1"}, {"LabelName": "/m/y", "TextName": "Y"}], "Part": [{"LabelName": "/m/p"}]},
  {"LabelName": "/m/b", "TextName": "B", "Subcategory": [{"LabelName": "/m/x", "TextName": "X"}, {"LabelName": "other"}]}, {"LabelName": "/m/c", "TextName": "C"}]}"""


def test_tree_walk(spark):
    nodes = hierarchy.flatten_tree(spark.createDataFrame([(TREE,)], "t string"), "t").cache()
    assert {r.label for r in hierarchy.tree_labels(nodes).collect()} == {"/m/a", "/m/b", "/m/c", "/m/x", "/m/y"}
    assert {r.label for r in hierarchy.internal_labels(nodes).collect()} == {"/m/a", "/m/b"}
    tops = {r.label: (r.top_label, r.n_tops) for r in hierarchy.top_ancestors(nodes).collect()}
    assert tops == {"/m/a": ("/m/a", 1), "/m/b": ("/m/b", 1), "/m/c": ("/m/c", 1), "/m/x": ("/m/a", 2), "/m/y": ("/m/a", 1)}
    assert {r.label: (r.parent_dir, r.leaf_dir) for r in hierarchy.leaf_paths(nodes).collect()}["/m/x"] == ("A", "X_1")
    with pytest.raises(Exception, match="several tops"):
        hierarchy.top_ancestors(nodes, policy="error").collect()


def test_nested_arrays(spark):
    df = spark.createDataFrame([('["a","b"]',), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(nested.parse_strings(F.col("t"))).collect()] == [["a", "b"], [], []]
    with pytest.raises(Exception, match="not a JSON array"):
        spark.createDataFrame([("{",)], "t string").select(nested.parse_strings(F.col("t"))).collect()


def test_greedy_pairs_equal_a_sequential_scan(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.1, 0.5, 0.9, round(rng.random(), 3), 1.0, float("nan")])) for _ in range(600)]
    used, want = set(), set()
    for a, b, v in sorted({e for e in edges if e[0] != e[1] and e[2] == e[2] and e[2] < 1}, key=lambda e: (-e[2], e[0], e[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b, v))
    got = matching.greedy_pairs(spark.createDataFrame(edges, "a long, b long, v double"), "a", "b", "v")
    assert set(map(tuple, got.collect())) == want


def test_greedy_pairs_never_return_a_part(spark):
    chain = spark.createDataFrame([(i, i + 1, 0.9 - i / 10) for i in range(5)], "a long, b long, v double")
    assert {(r.a, r.b) for r in matching.greedy_pairs(chain, "a", "b", "v", max_rounds=3).collect()} == {(0, 1), (2, 3), (4, 5)}
    try:
        matching.greedy_pairs(chain, "a", "b", "v", max_rounds=1)
    except RuntimeError:
        return
    raise AssertionError("a partial matching was returned")


def test_stratified_split_keeps_groups_and_nears_targets(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice("abcd")) for g in range(300) for _ in range(rng.randint(1, 3))]
    got = splits.systematic_stratified(spark.createDataFrame(rows, "g long, c string"), "g", ["c"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, set()).add(r.split)
    assert len(got) == len(rows) and all(len(s) == 1 for s in by.values())
    share = sum(r.split == "train" for r in got) / len(got)
    assert abs(share - 0.8) < 0.01


def test_balanced_batches_have_two_items_a_class(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(200)], "id long, c int")
    seen = {}
    for r in sampling.balanced_pairs(rows, "c", "id", 3).collect():
        seen.setdefault((r["round"], r.batch), []).append((r.c, r.id))
    assert all(sorted({c: 0 for c, _ in v}) == sorted({c for c, _ in v}) and len(v) == 2 * len({c for c, _ in v}) <= 6 for v in seen.values())


def test_distinct_image_batches(spark):
    rows = spark.createDataFrame([(i, f"c{i % 9}", f"img{i % 50}") for i in range(300)], "id long, c string, im string")
    seen = {}
    for r in sampling.distinct_image_batches(rows, "c", "id", "im", 2, parts=2).collect():
        seen.setdefault((r.part, r.batch), []).append(r)
    assert seen and all(len(v) == 4 and len({r.image for r in v}) == 4 and len({r.label for r in v}) == 2 for v in seen.values())


def test_resample_follows_weights(spark):
    items = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "k string, w double")
    got = {r.k: r["count"] for r in sampling.resample(items, "k", "w", 8000, seed=2).groupBy("k").count().collect()}
    assert sum(got.values()) == 8000 and abs(got["b"] / 8000 - 0.75) < 0.03 and "c" not in got


def test_donors_are_of_another_leaf_and_image(spark):
    rows = spark.createDataFrame([("p", "a", "i1"), ("p", "b", "i1"), ("p", "c", "i2"), ("q", "z", "i9")], "p string, f string, im string")
    got = {(r.f, r.im): (r.donor_leaf, r.donor) for r in sampling.donors(rows, "p", "f", "im").collect()}
    assert got == {("a", "i1"): ("c", "i2"), ("b", "i1"): ("c", "i2"), ("c", "i2"): ("a", "i1")}


def test_triplet_statuses(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [0.0, 1.0])], "id long, tag string, v array<double>")
    got = {r.anchor_id: (r.positive_id, r.negative_id, r.status) for r in neighbors.triplets(rows, "id", "v", "tag").collect()}
    assert got == {1: (2, 3, "ok"), 2: (1, 3, "ok"), 3: (None, 2, "no_positive")}


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    a, z = F.col("a"), F.col("z")
    r = df.select(vectors.norm(a), vectors.manhattan(a, z), vectors.euclidean(a, z), vectors.normalise(z), vectors.geodesic(z, z)).first()
    assert tuple(r[:3]) == (5.0, 7.0, 5.0) and r[3] == [0.0, 0.0] and r[4] < 1e-3


def test_state_machines(spark):
    seen = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, size int, mtime int")
    old = spark.createDataFrame([("a", 1, 1, "ok"), ("b", 9, 2, "ok"), ("d", 1, 1, "ok")], "path string, size int, mtime int, status string")
    scan = state.incremental_scan(seen, old)
    assert {r.path: r.action for r in scan.collect()} == {"a": "reuse", "b": "recompute", "c": "new", "d": "removed"}
    checked = spark.createDataFrame([("b", "bad")], "path string, status string")
    assert {r.path: r.status for r in state.next_state(scan, checked).collect()} == {"a": "ok", "b": "bad", "c": "pending"}
    tries = spark.createDataFrame([(1, "x", False, "e1"), (1, "y", True, None), (2, "x", False, "e1"), (2, "y", False, "e2")], "k int, origin string, ok boolean, error string")
    assert {r.k: (r.status, r.error) for r in state.fallback_status(tries, "k", ["x", "y"]).collect()} == {1: ("y", ""), 2: ("failed", "e1 | e2")}
    files = spark.createDataFrame([("i", "a/i.png", 5, "png"), ("i", "a/i.jpg", 0, "jpg"), ("j", "a/j.jpg", 0, "jpg")], "id string, path string, size int, ext string")
    got = state.with_file(spark.createDataFrame([("i",), ("j",), ("k",)], "id string"), files, ["id"], ["jpg", "png"])
    assert {r.id: (r.file, r.file_status) for r in got.collect()} == {"i": ("a/i.png", "present"), "j": (None, "empty"), "k": (None, "missing")}


def test_file_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿id,caption\n1,\"two\nlines \"\"q\"\"\"\n2,\n".encode())
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "t.csv"), ["id", "caption"]).collect()] == [("1", 'two\nlines "q"'), ("2", "")]
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.read_jsonl(spark, str(tmp_path / "t.jsonl"), "a int").collect()] == [1, 2]
    (tmp_path / "bad.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "tree/p/l").mkdir(parents=True)
    (tmp_path / "tree/p/l/x.JPG").write_bytes(b"123")
    (tmp_path / "tree/p/l/y.txt").write_bytes(b"1")
    assert [(r.parent, r.leaf, r.id, r.size) for r in readers.tree_listing(spark, str(tmp_path / "tree")).collect()] == [("p", "l", "x", 3)]


def test_tar_shards(spark, tmp_path):
    with tarfile.open(tmp_path / "s-00.tar", "w") as tar:
        for name, body in (("a.jpg", b"A"), ("a.txt", b"cap"), ("b.txt", b"no image"), ("c.PNG", b"C"), ("c.txt", b"x"), ("c.txt", b"again")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    samples = readers.read_shards(spark, [str(tmp_path / "s-00.tar")])
    assert [r.key for r in samples.orderBy("key").collect()] == ["a", "b", "c", "c"]
    assert {(r.key, bytes(r.image), r.text) for r in readers.image_text(samples).collect()} == {("a", b"A", "cap"), ("c", b"C", "x")}
    assert readers.expand_braces("s-{00..02}.tar::t{a,b}") == ["s-00.tar", "s-01.tar", "s-02.tar", "ta", "tb"]


def test_fetch_keeps_failures_as_rows(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("refused")
        return url.encode()

    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "k long, u string")
    got = {r.key: (r.content and bytes(r.content), r.error) for r in readers.fetch_urls(rows, "k", "u", fetch).collect()}
    assert got == {"1": (b"good", None), "2": (None, "OSError: refused")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, c string")
    calls = []
    for _ in range(2):
        out = sinks.cached_table(spark, str(tmp_path / "cache"), lambda: calls.append(1) or df, source="x", version=1)
        assert out.count() == 2
    assert len(calls) == 1 and sinks.fingerprint(df) == sinks.fingerprint(df.orderBy(F.desc("n")))
    sinks.write_by(df, "c", str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).where("c = 'a'").count() == 1
    assert contracts.same_rows(df, df) and not contracts.same_rows(df, df.limit(1))


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(src)

    def run():
        incremental.run_available(incremental.stream_table(spark, src), out, check)
        return spark.read.parquet(out).count()

    assert run() == 2 and run() == 2
    spark.createDataFrame([(3, "c")], "id int, v string").write.mode("append").parquet(src)
    assert run() == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("  a  b ", "p\\q/r_0123456789ABCDEF.jpg", ' x<y>. ')], "t string, path string, name string")
    r = df.select(text.strip_ws(F.col("t")), text.collapse_ws(F.col("t")), text.image_id(F.col("path")), text.path_part(F.col("path"), 2), text.safe_name(F.col("name")), text.is_safe_path(F.col("path"))).first()
    assert tuple(r) == ("a  b", "a b", "0123456789abcdef", "q", "x_y_", True)
    ids = spark.range(1).select(text.pad_ids(F.array(*map(F.lit, range(5))), 4, 9), text.pad_ids(F.array(F.lit(1)), 3, 9)).first()
    assert list(ids) == [[0, 1, 2, 9], [1, 0, 0]]
    assert spark.createDataFrame([("&amp;lt;b&amp;gt; ",)], "t string").select(text.unescape_twice("t")).first()[0] == "<b>"


def test_loss_terms(spark):
    logits = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 0, 0.0), (1, 1, 3.0)], "r int, c int, s double")
    import math

    rows = [math.log(math.exp(2) + math.exp(1)) - 2, math.log(1 + math.exp(3)) - 3]
    cols = [math.log(math.exp(2) + 1) - 2, math.log(math.exp(1) + math.exp(3)) - 3]
    assert abs(metrics.contrastive_loss(logits, "r", "c", "s").first().loss - sum(rows + cols) / 4) < 1e-12


def test_amplitude_mixing_keeps_phase_and_ends(spark):
    import numpy as np

    from quern.functions.arrays2d import amplitude_mixer, mix_amplitude

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(8, 8)), rng.normal(size=(8, 8))
    assert np.allclose(mix_amplitude(a, b, 0.0, 0.5), a)
    assert np.allclose(mix_amplitude(a, a, 0.7, 0.5), a)
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<double>, b array<double>")
    got = df.select(amplitude_mixer(8, 8, 0.3, 0.5)("a", "b")).first()[0]
    assert np.allclose(got, mix_amplitude(a, b, 0.3, 0.5).ravel())


def test_batch_positives_are_unique(spark):
    rows = spark.createDataFrame([(0, 1, "a", [1.0, 0.0]), (0, 2, "a", [0.8, 0.2]), (0, 3, "b", [0.0, 1.0]), (0, 4, "b", [0.1, 0.9])], "bt int, id long, tag string, v array<double>")
    got = {r.a: (r.positive, r.negative) for r in neighbors.batch_positives(rows, "bt", "id", "tag", "v").collect()}
    assert got == {1: (2, 4), 2: (1, 4), 3: (4, 2), 4: (3, 2)}
    with pytest.raises(Exception, match="exactly one positive"):
        neighbors.batch_positives(rows.where("id < 4"), "bt", "id", "tag", "v").collect()


def test_low_amplitudes_are_replaced_exactly():
    from quern.functions.arrays2d import mix_amplitude

    import numpy as np

    rng = np.random.default_rng(3)
    for shape, share in (((8, 8), 0.1), ((9, 6), 0.5), ((5, 7), 0.3)):
        a, b = rng.normal(size=shape), rng.normal(size=shape)
        f, g = np.fft.fftshift(np.fft.fft2(a)), np.fft.fftshift(np.fft.fft2(b))
        h, w = (max(1, round(n * share)) for n in shape)
        i, j = (shape[0] - h) // 2, (shape[1] - w) // 2
        want = np.abs(f)
        want[i : i + h, j : j + w] = np.abs(g)[i : i + h, j : j + w]
        assert np.allclose(mix_amplitude(a, b, share=share), np.fft.ifft2(np.fft.ifftshift(want * np.exp(1j * np.angle(f)))).real)
        assert np.allclose(mix_amplitude(np.stack([a, b]), np.stack([b, a]), share=share)[0], mix_amplitude(a, b, share=share))


def test_fingerprints_see_values_and_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i % 7}", None if i % 5 else 1.5) for i in range(500)], "i long, v string, x double")
    own = sinks.fingerprint(df, ["i"])
    assert own == sinks.fingerprint(df.orderBy(F.desc("i")).repartition(7), ["i"]) and len(own) == 64
    assert own != sinks.fingerprint(df.withColumn("v", F.when(F.col("i") == 3, "w").otherwise(F.col("v"))), ["i"])
    assert own != sinks.fingerprint(df.where("i <> 3"), ["i"]) and own != sinks.fingerprint(df.unionByName(df.limit(1)), ["i"])
    calls, root = [], str(tmp_path / "kept")
    sinks.cached_table(spark, root, lambda: calls.append(1) or df, name="x")
    import glob
    import os

    os.remove(glob.glob(f"{root}/*/_SUCCESS")[0])
    assert sinks.cached_table(spark, root, lambda: calls.append(1) or df, name="x").count() == 500 and len(calls) == 2


def test_numbers_in_groups(spark):
    rows = [(g, i) for g in "aab" "c" * 1 for i in range(1)] + [("hot", i) for i in range(3000)] + [(None, 5), (None, 6)]
    df = spark.createDataFrame(list(dict.fromkeys(rows)), "g string, i long").withColumn("d", F.sha2(F.col("i").cast("string"), 256))
    from quern.operators.windows import numbered_in_groups

    by = {}
    for r in numbered_in_groups(df, "g", "d", ["i"]).collect():
        by.setdefault(r.g, []).append((r.d, r["_place"], r["_size"], r["_all_before"]))
    starts = set()
    for own in by.values():
        own.sort()
        assert [x[1] for x in own] == list(range(len(own))) and {x[2] for x in own} == {len(own)}
        starts |= {(own[0][3], len(own))}
    at = 0
    for start, n in sorted(starts):
        assert start == at
        at += n


def test_every_class_is_split_eight_to_one_to_one(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(900)] + [(1000 + i, f"rare{i}") for i in range(40)]
    got = splits.systematic_stratified(spark.createDataFrame(rows, "g long, c string"), "g", ["c"]).collect()
    for c, n in (("a", 600), ("b", 300)):
        own = [r.split for r in got if r.c == c]
        assert len(own) == n and abs(own.count("train") - 0.8 * n) <= 1 and abs(own.count("validation") - 0.1 * n) <= 1
    rare = [r.split for r in got if r.c.startswith("rare")]
    assert abs(rare.count("test") - 4) <= 3 and abs([r.split for r in got].count("test") - 94) <= 1


def test_image_batches_use_nearly_everything(spark):
    """One class with a third of all items, images shared by classes: few items are left over, none comes twice."""
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 11}", f"img{i % 397}") for i in range(3000)]
    got = sampling.distinct_image_batches(spark.createDataFrame(rows, "id long, c string, im string"), "c", "id", "im", 2).collect()
    assert len({r.item for r in got}) == len(got) >= 0.7 * len(rows)


def test_donors_meet_images_by_place(spark):
    """Images shared by leaves, repeated ones and leaves without another image, against a plain search; no row carries a leaf's images."""
    import hashlib

    rows = [("p", f, i) for f, images in {"a": [1, 2, 2, 3], "b": [3], "c": [3, 3], "d": [2, 5, 9]}.items() for i in images] + [("q", "a", 1), ("r", "a", 1), ("r", "b", 1), ("p", "d", None)]
    got = sampling.donors(spark.createDataFrame(rows, "p string, f string, im long"), "p", "f", "im")
    want = {}
    for p, f, i in rows:
        leaves = sorted({g for q, g, _ in rows if q == p})
        start = int(hashlib.sha256(f"0:{p}:{f}:{i}".encode()).hexdigest()[:16], 16)
        for step in range(1, len(leaves)):
            leaf = leaves[(leaves.index(f) + step) % len(leaves)]
            images = sorted(x for q, g, x in rows if (q, g) == (p, leaf) and x is not None)
            turned = [x for x in images[start % len(images) :] + images[: start % len(images)] if x != i]
            if i is not None and turned:
                want[p, f, i] = (leaf, turned[0])
                break
    assert {(r.p, r.f, r.im): (r.donor_leaf, r.donor) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
