"""Guards that fail, folders, label sets and places against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import joins, metrics, neighbors, state
from quern.sources import readers


def test_members_and_folders_must_resolve(spark):
    rows = spark.createDataFrame([("a/cat/1.jpg",), ("b/dog/2.jpg",)], "path string")
    classes = spark.createDataFrame([("cat", 0), ("dog", 1)], "name string, label int")
    assert {tuple(r) for r in joins.label_from_folder(rows, "path", classes, "name", "label").collect()} == {("a/cat/1.jpg", 0), ("b/dog/2.jpg", 1)}
    with pytest.raises(Exception, match="not found"):
        joins.label_from_folder(rows, "path", classes.where("label = 0"), "name", "label").collect()
    with pytest.raises(Exception, match="not found"):
        joins.require_members(classes, classes.where("label = 1"), "name").collect()


def test_labelled_folder_numbers_classes_by_name(spark, tmp_path):
    for name in ("val/b/1.jpg", "val/b/x/2.png", "val/a/3.jpg", "val/4.jpg", "train/c/5.jpg"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = {(r.path, r["class"], r.label) for r in readers.labelled_folder(spark, str(tmp_path), "val").collect()}
    assert got == {("b/1.jpg", "b", 1), ("b/x/2.png", "b", 1), ("a/3.jpg", "a", 0)}


def test_sync_policies(spark):
    source = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 2, 5), ("d", 1, 5)], "path string, size int, mtime int")
    target = spark.createDataFrame([("a", 1, 5), ("b", 1, 4), ("c", 1, 6)], "path string, size int, mtime int")
    want = {"skip": "skipped_conflict", "overwrite": "overwritten"}
    for policy, other in want.items():
        got = {r.path: r.decision for r in state.sync_decisions(source, target, policy=policy, compare="mtime").collect()}
        assert got == {"a": "existing", "b": other, "c": other, "d": "copied"}
    got = {r.path: r.decision for r in state.sync_decisions(source, target, policy="newer", compare="mtime").collect()}
    assert got == {"a": "existing", "b": "overwritten", "c": "skipped_conflict", "d": "copied"}
    with pytest.raises(ValueError):
        state.sync_decisions(source, target, policy="maybe")


def test_neighbours_by_label_sets_and_scopes_in_small_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], rng.sample("abcdef", rng.randint(0, 2)) or None, rng.choice(["x", "y", None])) for i in range(60)]
    rows += [(60, rows[3][1], ["a"], "x"), (61, rows[3][1], ["b"], "x"), (62, None, ["b"], "x")]
    df = spark.createDataFrame(rows, "i long, v array<double>, tags array<string>, part string")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, *_ in rows if v}
    tags, part = {r[0]: set(r[2] or ()) for r in rows}, {r[0]: r[3] for r in rows}
    for rule in ("same", "other"):
        for scope in (None, "part"):
            want = {}
            for i in unit:
                near = [j for j in unit if j != i and bool(tags[i] & tags[j]) == (rule == "same") and (scope is None or part[i] == part[j])]
                want[i] = sorted(near, key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))[:3]
            got = {i: [] for i in unit}
            for r in neighbors.knn(df, "i", "v", "tags", 3, rule=rule, block_rows=7, scope=scope).orderBy("source_id", "rank").collect():
                got[r.source_id].append(r.neighbour_id)
            assert got == want


def test_contrastive_loss_does_not_overflow(spark):
    logits = spark.createDataFrame([(i, j, 2000.0 if i == j else 1990.0) for i in range(3) for j in range(3)], "r int, c int, s double")
    assert metrics.contrastive_loss(logits, "r", "c", "s").first().loss == pytest.approx(np.log(1 + 2 * np.exp(-10)), rel=1e-6)


def test_class_bound_is_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1)], "k int, v array<double>, label int")
    cent = metrics.class_centroids(rows, "label", "v", 2)
    assert metrics.zero_shot(rows, cent, "k", "v", "label").where("rank = 1 AND class = label").count() == 2
    with pytest.raises(ValueError):
        metrics.zero_shot(rows, cent, "k", "v", "label", most_classes=1)


def test_utc_text_and_quotes(spark):
    row = spark.createDataFrame([("a b/c*~é+",)], "u string").select(text.url_quote(F.col("u")).alias("q"), text.utc_text(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("t")).first()
    assert row.q == "a%20b/c%2A~%C3%A9%2B" and row.t == "2024-01-02T03:04:05+00:00"
