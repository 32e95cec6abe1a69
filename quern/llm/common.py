"""Shared helpers: table loading, lineage cuts, and vectorised views of Arrow text columns."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_B = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Powers of the base for the first bytes of a word; longer words turn the table once more for each 2**16 bytes.
_POWERS = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full((1 << 16) - 1, _B, np.uint64)])
#: A joined table of this many rows or fewer is broadcast; the callers' rows have under 200 bytes each.
SMALL_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder in spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a folder of its own; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quern-ckpt-"))
    return df.checkpoint(eager=True)


def join_small(rows: DataFrame, small: DataFrame, keys: list[str], n_small: int, how: str = "inner", salts: int = 32) -> DataFrame:
    """Equi-join with a table of ``n_small`` rows that has one row for each key.

    Up to ``SMALL_ROWS`` it is broadcast, so that hot keys of ``rows`` stay where they are; beyond that it is repeated for
    each of ``salts`` slices of a key, so that a hot key goes to as many tasks.
    """
    if n_small <= SMALL_ROWS:
        return rows.join(F.broadcast(small), keys, how)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(small, [*keys, "_salt"], how).drop("_salt")


def right_sized(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """Merge a small table's partitions so that a task has about ``per_task`` rows; loops over shrinking tables stay cheap."""
    return df.coalesce(max(1, -(-rows // per_task)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_slices(texts: pa.Array, max_bytes: int = 1 << 20):
    """Yield (first row, bytes, offsets) for runs of rows of about max_bytes; nulls are empty, whole texts stay together."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = ink.copy()
    starts[1:] &= ~ink[:-1] | edge[1:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: int = 1 << 21) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same wherever the word stands; about ``part`` bytes at a time."""
    out = np.zeros(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        stop = max(done + 1, int(np.searchsorted(ends, starts[done] + part, side="right")))
        first, last = int(starts[done]), int(ends[stop - 1])
        own = starts[done:stop] - first
        place = np.arange(last - first) - np.repeat(own, np.diff(np.r_[own, last - first]))
        value = _BYTE[data[first:last]] * _POWERS[place & 0xFFFF]
        if len(place) > 0xFFFF:
            value *= mix64((place >> 16).astype(np.uint64)) | np.uint64(1)
        value[SPACE[data[first:last]]] = 0
        out[done:stop] = np.add.reduceat(value, own)
        done = stop
    return mix64(out + (ends - starts).astype(np.uint64))
