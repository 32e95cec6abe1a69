"""The status machine and the bucketed upsert: replays, restarts, bytes touched, guards."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from quern.streaming import incremental, status

EVENTS = "key string, seq long, kind string, origin string, at timestamp, ok boolean, final boolean, error string"
BEGAN = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def machine(events, retries=2, base=10):
    state = None
    for e in events:
        state = status.step(state, dict(zip(("seq", "kind", "origin", "at", "ok", "final", "error"), e)), ["a", "b"], retries, base)
    return state


def test_steps():
    fail = lambda seq, origin, at, final=False: (seq, "attempt", origin, at, False, final, f"e{seq}")
    assert machine([(1, "attempt", "b", 0, True, False, None)])[:3] == ("pending", 0, 0)  # not its turn
    assert machine([(1, "attempt", "a", 0, True, False, None)])[0] == "a"
    assert machine([fail(1, "a", 100)])[:4] == ("pending", 0, 1, 110)
    assert machine([fail(1, "a", 100), fail(2, "a", 105)])[:4] == ("pending", 0, 1, 110)  # too early
    assert machine([fail(1, "a", 100), fail(2, "a", 110)])[:4] == ("pending", 1, 0, 0)
    assert machine([fail(1, "a", 100, True), fail(2, "b", 100, True)]) == ("failed", 1, 0, 0, 2, "a: e1 | b: e2")
    assert machine([fail(1, "a", 100, True), fail(1, "b", 100, True)])[:2] == ("pending", 1)  # a replay
    failed = [fail(1, "a", 0, True), fail(2, "b", 0, True)]
    assert machine([*failed, (3, "restart", None, 0, None, None, None)]) == ("pending", 0, 0, 0, 3, "")
    assert machine([*failed, (3, "vanish", None, 0, None, None, None)])[0] == "failed"
    done = [(1, "attempt", "a", 0, True, False, None)]
    assert machine([*done, (2, "vanish", None, 0, None, None, None)])[0] == "pending" and machine([*done, (2, "restart", None, 0, None, None, None)])[0] == "a"


def test_stream_equals_the_steps_and_goes_on(spark, tmp_path):
    spark.conf.set(*next(iter(status.CONF.items())))
    at = lambda s: BEGAN + datetime.timedelta(seconds=s)
    parts = [
        [("x", 1, "attempt", "a", at(0), False, False, "slow"), ("y", 1, "attempt", "a", at(0), True, False, None), ("z", 1, "attempt", "a", at(0), False, True, None)],
        [("x", 2, "attempt", "a", at(5), True, False, None), ("x", 3, "attempt", "a", at(70), True, False, None), ("y", 2, "vanish", None, at(9), None, None, None), ("z", 2, "attempt", "b", at(1), False, True, "404")],
        [("z", 3, "restart", None, at(100), None, None, None), ("w", 1, "attempt", "a", at(100), False, False, "slow")],
    ]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(f"{tmp_path}/in")
        stream = status.fetch_status(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), ["a", "b"])
        keep = lambda found, epoch, k=k: found.write.mode("overwrite").parquet(f"{tmp_path}/out/{k}-{epoch}")
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out/*").groupBy("key").agg(F.max(F.struct("seq", "status", "attempt", "error")).alias("m")).select("key", "m.*").collect()
        found = {r.key: (r.status, r.attempt, r.error) for r in got}
        if k == 0:
            assert found == {"x": ("pending", 1, "a: slow"), "y": ("a", 0, ""), "z": ("pending", 0, "a: failed")}
        if k == 1:
            assert found == {"x": ("a", 1, ""), "y": ("pending", 0, ""), "z": ("failed", 0, "a: failed | b: 404")}
    assert found == {"x": ("a", 1, ""), "y": ("pending", 0, ""), "z": ("pending", 0, ""), "w": ("pending", 1, "a: slow")}


def test_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    schema, out, state = "k long, t long, v string", f"{tmp_path}/table", f"{tmp_path}/state"
    apply = lambda: incremental.upsert_latest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "k", "t", out, state, buckets=8)
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = lambda: {f"{d}/{f}" for d, _, names in os.walk(f"{out}/rows") for f in names if f.startswith("part-")}
    add([(i, 1, f"old {i}") for i in range(200)] + [(None, 1, "none")])
    apply()
    before = files()
    add([(7, 2, "new"), (8, 0, "late"), (8, 1, "zz tie"), (500, 1, "more"), (7, 1, "older")])
    apply()
    changed = {p.split("_bucket=")[1].split("/")[0] for p in files() ^ before}
    touched = {str(r[0]) for r in spark.createDataFrame([(7,), (8,), (500,)], "k long").select(F.pmod(F.xxhash64("k"), F.lit(8))).collect()}
    assert changed == touched and len(touched) < 8
    rows = lambda: {r.k: (r.t, r.v) for r in incremental.read_upserted(spark, out).collect()}
    want = {i: (1, f"old {i}") for i in range(200)} | {None: (1, "none"), 7: (2, "new"), 8: (1, "zz tie"), 500: (1, "more")}
    assert rows() == want
    now = files()
    os.remove(f"{state}/commits/1"), os.remove(f"{state}/commits/.1.crc")
    apply()  # the batch is replayed and skipped
    assert files() == now and rows() == want
    os.remove(f"{out}/_epochs/1"), os.remove(f"{state}/commits/1"), os.remove(f"{state}/commits/.1.crc")
    apply()  # stopped before its marker: applied again
    assert rows() == want
    with pytest.raises(ValueError, match="differ"):
        incremental.upsert_latest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "k", "v", out, f"{tmp_path}/other", buckets=8)
