"""Tar shards, the loader chain and line streams: ranges, breaks, splits, resumes."""

import glob
import io
import json
import os
import tarfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.sources import shards
from quern.streaming import lines


def archive(path, members):
    with tarfile.open(path, "w") as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return str(path)


MEMBERS = [("d/a.JPG", b"A"), ("d/a.txt", b"one"), ("readme", b"skipped"), ("b.jpg", b"B"), ("b.jpg", b"B2"), ("b.txt", b"two"), ("c.x.txt", b"c" * 3000), (".hidden", b"no")]
WANT = [("d/a", {"jpg": b"A", "txt": b"one"}), ("b", {"jpg": b"B"}), ("b", {"jpg": b"B2", "txt": b"two"}), ("c", {"x.txt": b"c" * 3000})]


@pytest.mark.parametrize("range_bytes", [0, 512, 1500, 5000])
def test_samples_by_ranges(spark, tmp_path, range_bytes):
    path = archive(tmp_path / "s.tar", MEMBERS)
    rows = shards.stream_shards(spark, [path], range_bytes=range_bytes).orderBy("offset").collect()
    assert [(r.key, {k: bytes(v) for k, v in r.parts.items()}) for r in rows] == WANT and not any(r.error for r in rows)


def test_broken_archives_give_error_rows(spark, tmp_path):
    whole = archive(tmp_path / "a.tar", [("a.txt", b"1"), ("b.txt", b"2" * 2000), ("c.txt", b"3")])
    raw = open(whole, "rb").read()
    cases = {"cut.tar": raw[:2200], "garbage.tar": raw[:1024] + b"?" * 1024 + raw[2048:], "text.tar": b"no archive at all" * 100}
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    rows = shards.stream_shards(spark, [whole, *(str(tmp_path / n) for n in cases), str(tmp_path / "none.tar")]).collect()
    of = {}
    for r in rows:
        of.setdefault(os.path.basename(r.shard), []).append(r.key if r.error is None else "error")
    assert of == {"a.tar": ["a", "b", "c"], "cut.tar": ["a", "error"], "garbage.tar": ["a", "error"], "text.tar": ["error"], "none.tar": ["error"]}
    assert [(r.key, r.error is None) for r in shards.stream_shards(spark, [whole], most_bytes=100).orderBy("offset").collect()] == [("a", True), ("b", False), ("c", True)]


def test_a_shard_beyond_two_gigabytes(spark, tmp_path):
    path = tmp_path / "big.tar"
    with open(path, "wb") as out:
        for name, size in (("x.txt", 3), ("filler", (2 << 30) + 512 * 9), ("y.txt", 3)):
            info = tarfile.TarInfo(name)
            info.size = size
            out.write(info.tobuf())
            if size == 3:
                out.write(b"abc" + b"\0" * 509)
            else:
                out.seek(size, 1)  # a hole: no disk is used
        out.write(b"\0" * 1024)
    got = shards.stream_shards(spark, [str(path)], range_bytes=1 << 30).collect()
    assert sorted((r.key, bytes(r.parts["txt"])) for r in got) == [("x", b"abc"), ("y", b"abc")]


def test_nodes_and_workers_share_the_shards(spark, tmp_path):
    paths = [archive(tmp_path / f"{i}.tar", [(f"{i}-{j}.txt", b"t") for j in range(i + 1)] + [(f"{i}-{j}x.jpg", b"i") for j in range(1)]) for i in range(7)]
    one = shards.stream_shards(spark, paths, seed=5, epoch=2, nodes=2, workers=2)
    order = [r.shard for r in one.select("place", "shard").distinct().orderBy("place").collect()]
    assert sorted(order) == sorted(paths) and order != paths and order == shards.shard_order(paths, 5, 2) != shards.shard_order(paths, 5, 3)
    for node in (0, 1):
        own = shards.stream_shards(spark, paths, seed=5, epoch=2, nodes=2, node=node, workers=2).select("place", "worker").distinct().collect()
        assert sorted((r.place, r.worker) for r in own) == [(p, p // 2 % 2) for p in range(node, 7, 2)]
    assert shards.stream_shards(spark, paths[:1], nodes=2, node=1).count() == 0


def test_loader_batches(spark, tmp_path):
    paths = [archive(tmp_path / f"{i}.tar", [m for j in range(5 + 6 * i) for m in ((f"{i}-{j}.png", b"i"), (f"{i}-{j}.txt", f"{i} {j}".encode()))] + [("z.txt", b"no image")]) for i in range(3)]
    for cap in (None, 1, 7):
        rows = shards.load_batches(spark, paths, batch=4, seed=1, nodes=3, cap=cap).collect()
        by = Counter((r.node, r.batch) for r in rows)
        assert set(by.values()) == {4}
        size = {r.node: int(r.shard[0]) for r in rows}
        for node, shard in size.items():
            assert sorted(b for n, b in by if n == node) == list(range(cap or (5 + 6 * shard) // 4))
    again = shards.load_batches(spark, paths, batch=4, seed=1, nodes=3, cap=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    passes = [[r.key for r in sorted(rows, key=lambda r: (r.batch, r.item)) if r.shard == "1.tar" and r.batch // 2 == p] for p in (0, 1)]
    assert len(passes[0]) == len(set(passes[0])) == 8 and passes[0] != passes[1]
    val = sorted(shards.load_batches(spark, paths, batch=4, train=False).collect(), key=lambda r: (r.batch, r.item))
    assert [(r.shard, r.key) for r in val] == [(f"{i}.tar", f"{i}-{j}") for i in range(3) for j in range(5 + 6 * i)]
    assert [r.batch for r in val] == [i // 4 for i in range(33)]


def test_written_shards_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, None if i == 4 else f"text {i}", bytes([i])) for i in range(20)], "s int, k int, t string, b binary")
    sizes = {r.shard: r.n_samples for r in shards.write_shards(df, f"{tmp_path}/out", "s", "k", {"txt": "t", "bin": "b"}).collect()}
    assert sizes == {"0.tar": 7, "1.tar": 7, "2.tar": 6} and sorted(os.listdir(tmp_path / "out")) == sorted(sizes)
    got = shards.stream_shards(spark, [f"{tmp_path}/out/{n}" for n in sizes]).collect()
    assert {(r.key, bytes(r.parts["bin"]), r.parts.get("txt") and r.parts["txt"].decode()) for r in got} == {(str(i), bytes([i]), None if i == 4 else f"text {i}") for i in range(20)}


def run(stream, out, state):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_line_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, out, state = tmp_path / "in.jsonl", f"{tmp_path}/out", f"{tmp_path}/state"
    objects = [{"i": i, "t": "é" * (i % 50)} for i in range(900)]
    written = ["﻿" * (i == 0) + json.dumps(o, ensure_ascii=False) + "\n" for i, o in enumerate(objects)]
    read = lambda: lines.stream_jsonl(spark, str(path), "i long, t string", split_bytes=777)
    for k in range(3):
        with open(path, "a", encoding="utf-8") as f:
            f.write("".join(written[300 * k : 300 * (k + 1)]).rstrip("\n" if k == 2 else ""))
        run(read(), out, state)
        run(read(), out, state)  # nothing new: nothing is read
        got = spark.read.parquet(out)
        assert sorted((r.i, r.t) for r in got.collect()) == [(o["i"], o["t"]) for o in objects[: 300 * (k + 1)]]
        if k == 1:  # a batch whose commit was lost is run again over the same bytes
            last = max(int(os.path.basename(p)) for p in glob.glob(f"{state}/commits/[0-9]*"))
            os.remove(f"{state}/commits/{last}"), os.remove(f"{state}/commits/.{last}.crc")
            run(read(), out, state)
            assert spark.read.parquet(out).count() == 600
    raw = open(path, "rb").read()
    assert all(json.loads(raw[r.offset :].split(b"\n")[0].decode("utf-8-sig"))["i"] == r.i for r in got.collect())
    assert spark.read.json(str(path)).count() == got.count()


@pytest.mark.parametrize("line", ["", "   ", "[1]", "{bad", '"text"'])
def test_line_stream_refuses_what_is_no_object(spark, tmp_path, line):
    (tmp_path / "in.jsonl").write_text('{"i": 1}\n' + line + '\n{"i": 2}\n')
    with pytest.raises(Exception, match="no JSON object at byte 9"):
        run(lines.stream_jsonl(spark, str(tmp_path / "in.jsonl"), "i long"), f"{tmp_path}/out", f"{tmp_path}/state")


def test_line_stream_guards_what_was_read(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"i": 1}\n{"i": 2}\n')
    run(lines.stream_jsonl(spark, str(path), "i long"), f"{tmp_path}/out", f"{tmp_path}/state")
    path.write_text('{"i": 3}\n{"i": 4}\n{"i": 5}\n')
    with pytest.raises(Exception, match="changed before byte 18"):
        run(lines.stream_jsonl(spark, str(path), "i long"), f"{tmp_path}/out", f"{tmp_path}/state")


def test_a_range_is_found_by_the_index(spark, tmp_path, monkeypatch):
    """A range's task walked all headers before it, so that reading a shard by ranges took the square of its samples."""
    rows = spark.range(400).select(F.lit("s").alias("shard"), F.col("id").alias("key"), F.repeat(F.lit("x"), (F.col("id") % 7 * 500).cast("int")).alias("text"))
    shards.write_shards(rows, str(tmp_path), "shard", "key", {"txt": "text"}).collect()
    path = f"{tmp_path}/s.tar"
    size, walked, read = os.path.getsize(path), [], []
    tarinfo = tarfile.TarFile.next
    monkeypatch.setattr(tarfile.TarFile, "next", lambda self: walked.append(1) or tarinfo(self))
    whole = list(shards.samples(path))
    all_headers = len(walked)
    walked.clear()
    for first in range(0, size, 1 << 16):
        read += shards.samples(path, first, first + (1 << 16))
    assert read == whole and len(whole) == 400
    assert len(walked) < 4 * all_headers
    os.remove(f"{tmp_path}.index/s.tar")
    walked.clear()
    assert list(shards.samples(path, 1 << 16, 1 << 17)) == [s for s in whole if 1 << 16 <= s[0] < 1 << 17]


@pytest.mark.parametrize("in_place", [True, False])
def test_a_shard_is_written_by_many_tasks(spark, tmp_path, monkeypatch, in_place):
    """One task wrote a shard, so what it read grew with the shard."""
    rows = spark.range(0, 600, 1, 5).select(F.concat(F.lit("s"), (F.col("id") >= 20).cast("int")).alias("shard"), F.col("id").alias("key"), F.repeat(F.lit("xé"), (F.col("id") % 7 * 300).cast("int")).alias("text"))
    seen = []
    segments = shards._segments
    monkeypatch.setattr(shards, "_segments", lambda folder, members: seen.append(members) or segments(folder, members))
    monkeypatch.setattr(shards.stores, "writes_in_place", lambda path: in_place)
    out = f"{tmp_path}/out"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        written = shards.write_shards(rows, out, "shard", "key", {"jpg": "text", "txt": "text"})
        assert {r.shard: r.n_samples for r in written.collect()} == {"s0.tar": 20, "s1.tar": 580}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert seen == [[("jpg", 0), ("txt", 0)]]  # a column is sent once
    assert sorted(os.listdir(out)) == ["s0.tar", "s1.tar"] and not os.listdir(f"{out}.segments")
    want = {r.key: r.text.encode() for r in rows.collect()}
    with tarfile.open(f"{out}/s1.tar") as tar:
        names = tar.getnames()
    assert names == [f"{k}.{p}" for k in sorted(map(str, range(20, 600))) for p in ("jpg", "txt")]
    size, *starts = json.load(open(f"{out}.index/s1.tar"))
    begins = [s[0] for s in shards.samples(f"{out}/s1.tar")]
    assert size == os.path.getsize(f"{out}/s1.tar") and set(starts) <= set(begins) and starts == sorted(starts)
    got = shards.stream_shards(spark, [f"{out}/s{i}.tar" for i in (0, 1)], range_bytes=1 << 16).collect()
    assert not any(r.error for r in got) and len(got) == 600
    assert all(bytes(r.parts["jpg"]) == bytes(r.parts["txt"]) == want[int(r.key)] for r in got)
    dealt = rows.select(F.col("shard").alias("_shard"), F.col("key").cast("string").alias("_key"), F.col("text").cast("binary").alias("_0"))
    made = dealt.repartitionByRange(4, "_shard", "_key").sortWithinPartitions("_shard", "_key").mapInArrow(segments(f"{tmp_path}/two", [("txt", 0)]), shards._SEGMENT)
    assert made.where("shard = 's1'").count() >= 3
