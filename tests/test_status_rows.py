"""The status machine takes and gives plain rows: one read of the state a key, one write only where it changes, and odd events as before."""

import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.streaming import status

EVENTS = "key string, seq long, kind string, origin string, at timestamp, ok boolean, final boolean, error string"
BEGAN = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(s):
    return BEGAN + datetime.timedelta(seconds=s)


def event(seq, s, ok, final=True, origin="a", error=None, kind="attempt"):
    return Row(key="x", seq=seq, kind=kind, origin=origin, at=at(s), ok=ok, final=final, error=error)


class Handle:
    """The state of one key; counts its calls and keeps its timers."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, ms):
        self.timers.append(ms)


def machine():
    handle, made = Handle(), status.StatusMachine(["a", "b"], 2, 10)
    made.init(handle)
    return handle, made


def test_a_key_needs_one_read_and_a_change_one_write():
    handle, made = machine()
    first = [event(2, 100, False, final=False), event(1, 0, None, kind=None)]
    (row,) = made.handleInputRows(("x",), iter(first), None)
    due = int(at(110).timestamp())
    assert row.asDict() == {"key": "x", "seq": 2, "status": "pending", "origin": "a", "attempt": 1, "due": due, "error": "a: failed"}
    assert handle.calls == ["get", "update"] and handle.timers == [1000 * due]
    assert [*made.handleExpiredTimer(("x",), None, None)] == [row]
    handle.calls.clear()
    assert [*made.handleInputRows(("x",), iter(first), None)] == [] and handle.calls == ["get"]  # a replay


def test_events_without_seq_come_last_in_their_batch():
    handle, made = machine()
    (row,) = made.handleInputRows(("x",), iter([event(None, 0, True, origin="b"), event(3, 0, False)]), None)
    assert (row.seq, row.status) == (None, "b")


def test_odd_events_in_a_stream(spark, tmp_path):
    spark.conf.set(*next(iter(status.CONF.items())))
    rows = [(None, 1, "attempt", "a", at(0.7), False, False, None), (None, 2, "attempt", "a", at(0.9), True, False, None)]
    rows += [("twice", 1, "attempt", "a", at(0), False, True, "e")] * 3 + [("twice", 1, "attempt", "b", at(0), True, True, None)]
    rows += [("nulls", 1, "attempt", "a", at(0), None, None, None), ("nulls", 2, None, "a", at(99), True, None, None), ("nulls", 3, "attempt", None, at(99), True, None, None)]
    rows += [("early", -1, "attempt", "a", at(0), True, True, None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/in")
    stream = status.fetch_status(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), ["a", "b"], base=10)
    found = []
    keep = lambda batch, epoch: found.extend(batch.select("key", "seq", "status", "origin", "attempt", (F.col("due") - int(BEGAN.timestamp())).alias("due"), "error").collect())
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    none = -int(BEGAN.timestamp())
    assert {tuple(r) for r in found} == {
        (None, 2, "pending", "a", 1, 10, "a: failed"), ("twice", 1, "pending", "b", 0, none, "a: e"),
        ("nulls", 3, "pending", "a", 1, 10, "a: failed"), ("early", -1, "pending", "a", 0, none, ""),
    } and len(found) == 4
