"""The fetch status of every row as keyed state: ordered origins, retries with back-off, restarts, vanished files."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, seq long, status string, origin string, attempt int, due long, error string"
STATE = "status string, place int, attempt int, due long, seq long, error string"
MOST_ERROR = 4000


def step(state: tuple | None, event: dict, origins: list[str], retries: int, base: int) -> tuple:
    """The state (status, place of the origin, attempt, due time, last seq, errors) after one event.

    ``attempt``: an attempt at the current origin that is due; others are late or early and change nothing. It succeeds, and the origin is the
    status; or is refused (``final``) and the next origin comes; or fails and is due again after ``base`` * 2**attempt, up to
    ``retries`` times, then the next origin comes. After the last origin the status is failed. ``restart`` brings a failed
    row, ``vanish`` a finished one back to pending. An event that is not later than the last one is a replay and changes nothing.
    """
    status, place, attempt, due, seq, error = state or ("pending", 0, 0, 0, -1, "")
    if event["seq"] <= seq:
        return status, place, attempt, due, seq, error
    seq, kind = event["seq"], event["kind"]
    if (kind == "restart" and status == "failed") or (kind == "vanish" and status in origins):
        return "pending", 0, 0, 0, seq, ""
    if kind != "attempt" or status != "pending" or event["origin"] != origins[place] or event["at"] < due:
        return status, place, attempt, due, seq, error
    if event["ok"]:
        return event["origin"], place, attempt, 0, seq, ""
    error = " | ".join(x for x in (error, f"{event['origin']}: {event['error'] or 'failed'}") if x)[:MOST_ERROR]
    if not event["final"] and attempt + 1 < retries:
        return status, place, attempt + 1, event["at"] + base * 2**attempt, seq, error
    if place + 1 < len(origins):
        return status, place + 1, 0, 0, seq, error
    return "failed", place, attempt, 0, seq, error


class StatusMachine(StatefulProcessor):
    """State is one row a key; a timer in event time tells when a delayed attempt is due.

    It takes and gives plain rows: with pandas each key of a batch costs several small frames, far more than its events.
    """

    def __init__(self, origins: list[str], retries: int, base: int):
        self.origins, self.retries, self.base = origins, retries, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", STATE)

    def _row(self, key, state) -> Row:
        status, place, attempt, due, seq, error = state
        origin = self.origins[place] if status in ("pending", *self.origins) else None
        return Row(key=key, seq=None if math.isnan(seq) else seq, status=status, origin=origin, attempt=attempt, due=due, error=error)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.state.get()
        state = before
        events = [row.asDict() for row in rows]
        for event in events:
            event["seq"] = math.nan if event["seq"] is None else event["seq"]  # last of its batch, and later than any
            event["at"] = int(event["at"].replace(tzinfo=timezone.utc).timestamp())
        for event in sorted(events, key=lambda e: (math.isnan(e["seq"]), e["seq"])):
            state = step(state, event, self.origins, self.retries, self.base)
        if state == before:
            return
        self.state.update(state)
        if state[3] and state[3] != (before[3] if before else 0):
            self.handle.registerTimer(1000 * state[3])
        yield self._row(key[0], state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.state.get()
        if state and state[0] == "pending" and state[3]:
            yield self._row(key[0], state)

    def close(self) -> None:
        pass


def fetch_status(events: DataFrame, origins: list[str], retries: int = 3, base: int = 60, delay: str = "365 days") -> DataFrame:
    """Changes of status of every key from a stream ``key, seq, kind, origin, at, ok, final, error``; see :func:`step` for the rules.

    ``seq`` orders the events of a key (within a batch they are sorted), ``at`` is a timestamp; events later than ``delay`` behind the
    newest are dropped. A change is emitted once for each key and batch, ``key, seq, status, origin, attempt, due, error``, and a
    pending row again when time has passed its ``due`` (in seconds), so that a fetcher can follow the stream. The row with the largest ``seq`` is
    the status. The session needs the RocksDB state store (:data:`CONF`); state grows with the keys, not with the events.
    """
    machine = StatusMachine(list(origins), retries, base)
    timed = events.withColumn("at", F.col("at").cast("timestamp"))
    return timed.withWatermark("at", delay).groupBy("key").transformWithState(machine, OUT, "update", "eventTime")


#: The state store that keyed processors need.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
