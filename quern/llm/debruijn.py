"""Removal of repeated word windows by a compacted De Bruijn graph of the corpus.

An edge is a window of k words, its ends are the windows of k - 1 words it begins and ends with. Only edges that occur twice go on.
A path of repeated edges is cut where it branches and, as if documents began and ended at a node of their own,
where an occurrence begins or ends. What remains are paths that every occurrence runs through whole, so a document's own
order compacts them: edges and junctions meet the documents in two joins, and no path is walked by a chain of joins.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, mix64, text_slices, word_hashes, word_spans
from quern.llm.repeats import _keys, _member, _parts, _unzip, _unzip_sorted, _zip, _zip_sorted

_NO_ID = (1 << 63) - 1
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Contexts of an edge: none (a walk begins or ends), several, or else a hash of the neighbouring edge.
_NONE, _SEVERAL = np.uint32(0), np.uint32(1)
_LEFT, _RIGHT = np.uint8(1), np.uint8(2)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k words, from hashes of runs of 1, 2, 4, ... words."""
    out, done, power, span = None, 0, words, 1
    while True:
        if k & span:
            if out is None:
                out = power
            else:
                n = max(0, len(words) - done - span + 1)
                out = mix64(out[:n] * _STEP + power[done : done + n] * _TURN)
            done += span
        span *= 2
        if span > k:
            return out[: max(0, len(words) - k + 1)]
        half, n = span // 2, max(0, len(power) - span // 2)
        power = mix64(power[:n] * _STEP + power[half : half + n] * _TURN)


def _slices(max_bytes: int):
    """Documents packed into slices of about ``max_bytes``: ids, words of each, digests of their words, and the words, one space after each."""
    schema = pa.schema([(c, pa.binary()) for c in ("ids", "words", "ties", "data")])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, offsets in text_slices(batch.column("text"), max_bytes):
                starts, ends, doc = word_spans(data, offsets)
                length = ends - starts
                out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
                place = np.cumsum(length + 1) - length - 1
                inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                out[np.repeat(place, length) + inside] = data[np.repeat(starts, length) + inside]
                words = np.bincount(doc, minlength=len(offsets) - 1).astype(np.int64)
                bounds = np.r_[place, len(out)][np.r_[0, np.cumsum(words)]]
                ties = b"".join(hashlib.blake2b(out[a:b], digest_size=4).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                values = (ids[row : row + len(words)].tobytes(), words.tobytes(), ties, _zip(out, 3))
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], schema=schema)

    return run


class Slice:
    """One slice: ids, words and windows of its documents, and the bytes of every word."""

    def __init__(self, row: dict):
        self.ids, self.words, self.ties = (np.frombuffer(row[c], kind) for c, kind in (("ids", np.int64), ("words", np.int64), ("ties", np.int32)))
        self.data = _unzip(row["data"], np.uint8)
        self.ends = np.flatnonzero(self.data == 0x20)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        self.first = np.r_[0, np.cumsum(self.words)]

    def windows(self, buckets: int, k: int, bits: int):
        """Yield, for some documents at a time, the keys of their windows, each one's document and its place among the slice's words."""
        bounds = np.r_[self.starts, len(self.data)][self.first]
        for a, b in _parts(bounds, 1 << 21):
            lo, hi = self.first[a], self.first[b]
            if hi - lo < k:
                continue
            base = bounds[a]
            h = window_hashes(word_hashes(self.data[base : bounds[b]], self.starts[lo:hi] - base, self.ends[lo:hi] - base), k)
            doc = np.repeat(np.arange(a, b), self.words[a:b])[: len(h)]
            ok = np.arange(lo, lo + len(h)) + k <= self.first[doc + 1]
            if bits < 64:
                h = mix64(h & np.uint64((1 << bits) - 1))
            if ok.any():
                yield _keys(h[ok], buckets), doc[ok], np.flatnonzero(ok) + lo


def _by_bucket(keys: np.ndarray, buckets: int):
    """Bucket, first and last place of every bucket's run of sorted keys."""
    cuts = np.searchsorted((keys >> np.uint64(40)).astype(np.int64), np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), cuts[k], cuts[k + 1]


_REM = np.uint64((1 << 40) - 1)


def _edges(buckets: int, k: int, bits: int):
    """For every bucket the slice's edges, those that the slice has once and those it has more often."""
    schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("single", pa.binary()), ("multi", pa.binary())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = [keys for keys, _, _ in Slice(row).windows(buckets, k, bits)]
                if not found:
                    continue
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                out = [[], [], [], []]
                for bucket, a, b in _by_bucket(keys, buckets):
                    part, once = keys[a:b] & _REM, counts[a:b] == 1
                    for column, value in zip(out, (bucket, row["slice"], _zip_sorted(part[once]), _zip_sorted(part[~once]))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _repeated(key, rows):
    """For every slice its edges of this bucket that occur twice or more in the corpus."""
    slices, keys, counts, owner = rows["slice"].to_pylist(), [], [], []
    for i, raw in enumerate(zip(rows["single"].to_pylist(), rows["multi"].to_pylist())):
        for n, part in enumerate(raw, 1):
            found = _unzip_sorted(part)
            keys.append(found), counts.append(np.full(len(found), n, np.int8)), owner.append(np.full(len(found), i, np.int32))
    keys, counts, owner = np.concatenate(keys), np.concatenate(counts), np.concatenate(owner)
    order = np.argsort(keys, kind="stable")
    keys, counts, owner = keys[order], counts[order], owner[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    often = counts > 1
    often[:-1] |= ~new[1:]
    often |= ~new
    keys, owner = keys[often], owner[often]
    order = np.lexsort((keys, owner))
    keys, cuts = keys[order], np.searchsorted(owner[order], np.arange(len(slices) + 1))
    own = np.flatnonzero(np.diff(cuts))
    columns = [[slices[i] for i in own], [key[0].as_py()] * len(own), [_zip_sorted(np.unique(keys[cuts[i] : cuts[i + 1]])) for i in own]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], names=["slice", "bucket", "keys"])


def _gathered(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    """A slice's edges from all buckets in order, and what came along with them."""
    keys, more = [np.zeros(0, np.uint64)], [[np.zeros(0, np.uint8)] for _ in columns]
    for bucket, raw, *along in zip(*(rows[c].to_pylist() for c in ("bucket", "keys", *columns))):
        keys.append(_unzip_sorted(raw) | (np.uint64(bucket) << np.uint64(40)))
        for have, x in zip(more, along):
            have.append(_unzip(x, np.uint8))
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    return [keys[order], *(np.concatenate(have)[order] for have in more)]


def _walks(keys: np.ndarray, doc: np.ndarray, place: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the repeated windows, and whether each follows the one before it in a walk."""
    at = np.flatnonzero(_member(keys, repeated))
    follows = np.zeros(len(at), bool)
    follows[1:] = (np.diff(place[at]) == 1) & (doc[at][1:] == doc[at][:-1])
    return at, follows


def _contexts(buckets: int, k: int, bits: int):
    """For every bucket the slice's repeated edges with the edge before and the edge after them."""
    schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])

    def run(_, slices, repeated):
        out = [[], [], [], [], []]
        for row in slices.to_pylist() if len(repeated) else ():
            (edges,) = _gathered(repeated)
            sides = [np.zeros(len(edges), np.uint32), np.zeros(len(edges), np.uint32)]
            seen = np.zeros(len(edges), bool)
            for keys, doc, place in Slice(row).windows(buckets, k, bits):
                at, follows = _walks(keys, doc, place, edges)
                own = keys[at]
                name = np.maximum((mix64(own) >> np.uint64(32)).astype(np.uint32), np.uint32(2))
                before, after = np.full(len(at), _NONE), np.full(len(at), _NONE)
                before[1:][follows[1:]], after[:-1][follows[1:]] = name[:-1][follows[1:]], name[1:][follows[1:]]
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]]) if len(own) else np.zeros(0, np.int64)
                to = np.searchsorted(edges, own[order][first])
                for side, value in zip(sides, (before, after)):
                    low, high = (f.reduceat(value[order], first) if len(first) else value for f in (np.minimum, np.maximum))
                    now = np.where(low == high, low, _SEVERAL)
                    side[to] = np.where(seen[to] & (side[to] != now), _SEVERAL, now)
                seen[to] = True
            for bucket, a, b in _by_bucket(edges, buckets):
                for column, value in zip(out, (bucket, row["slice"], _zip_sorted(edges[a:b] & _REM), _zip(sides[0][a:b]), _zip(sides[1][a:b]))):
                    column.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _junctions(key, rows):
    """For every slice its repeated edges of this bucket, flagged where a path has to end before or after them."""
    slices, keys, left, right, owner = rows["slice"].to_pylist(), [], [], [], []
    for i, raw in enumerate(zip(*(rows[c].to_pylist() for c in ("keys", "left", "right")))):
        keys.append(_unzip_sorted(raw[0])), left.append(_unzip(raw[1], np.uint32)), right.append(_unzip(raw[2], np.uint32))
        owner.append(np.full(len(keys[-1]), i, np.int32))
    keys, left, right, owner = (np.concatenate(x) for x in (keys, left, right, owner))
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    flags = np.zeros(len(keys), np.uint8)
    for side, flag in ((left[order], _LEFT), (right[order], _RIGHT)):
        low, high = np.minimum.reduceat(side, first), np.maximum.reduceat(side, first)
        flags |= np.repeat(np.where((low != high) | (low <= _SEVERAL), flag, np.uint8(0)), np.diff(np.r_[first, len(keys)]))
    order = np.lexsort((keys, owner))
    keys, flags, cuts = keys[order], flags[order], np.searchsorted(owner[order], np.arange(len(slices) + 1))
    spans = [slice(cuts[i], cuts[i + 1]) for i in range(len(slices))]
    columns = [slices, [key[0].as_py()] * len(slices), [_zip_sorted(keys[x]) for x in spans], [_zip(flags[x]) for x in spans]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["slice", "bucket", "keys", "flags"])


_PATH = pa.schema([("path", pa.int64()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int32()), ("slice", pa.int64()), ("doc", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])
_PATH_SQL = "path long, digest long, doc_id long, tie int, slice long, doc int, start int, n int"


def _located(own: Slice, number: int, path: np.ndarray | None, doc: np.ndarray, place: np.ndarray, n: np.ndarray, k: int) -> pa.Table:
    """Rows of paths: key of the first edge, digest of the words read at the source, and where they stand; ``n`` counts edges.

    Without ``path`` the key is a second digest of the words.
    """
    raw = own.data.tobytes()
    begin, end = own.starts[place].tolist(), own.ends[place + n + k - 2].tolist()
    digests = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin, end)), np.int64).reshape(-1, 2)
    path = digests[:, 1] if path is None else path.astype(np.int64)
    values = (path, digests[:, 0], own.ids[doc], own.ties[doc], np.full(len(doc), number), doc, place - own.first[doc], n)
    return pa.table([pa.array(np.ascontiguousarray(v), f.type, safe=False) for v, f in zip(values, _PATH)], schema=_PATH)


def _paths(buckets: int, k: int, bits: int):
    """The slice's walks over repeated edges, cut at junctions: every occurrence of every compacted path."""

    def run(_, slices, junctions):
        out = [_PATH.empty_table()]
        for row in slices.to_pylist() if len(junctions) else ():
            edges, flags = _gathered(junctions, "flags")
            own = Slice(row)
            for keys, doc, place in own.windows(buckets, k, bits):
                at, follows = _walks(keys, doc, place, edges)
                flag = flags[np.searchsorted(edges, keys[at])] if len(at) else np.zeros(0, np.uint8)
                begins = ~follows | (flag & _LEFT > 0)
                begins[1:] |= flag[:-1] & _RIGHT > 0
                first = np.flatnonzero(begins)
                if len(first):
                    out.append(_located(own, row["slice"], keys[at[first]], doc[at[first]], place[at[first]], np.diff(np.r_[first, len(at)]), k))
        return pa.concat_tables(out)

    return run


def _windows(k: int):
    """Every window of given paths as a path of its own, named by its digest."""

    def run(_, slices, paths):
        out = [_PATH.empty_table()]
        for row in slices.to_pylist() if len(paths) else ():
            own = Slice(row)
            doc, start, n = (paths[c].to_numpy().astype(np.int64) for c in ("doc", "start", "n"))
            each = np.repeat(doc, n)
            place = np.repeat(own.first[doc] + start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(_located(own, row["slice"], None, each, place, np.ones(len(each), np.int64), k))
        return pa.concat_tables(out)

    return run


def _cut(k: int, digest: bool):
    """Remove the words covered by later occurrences from every document of a slice."""
    last = pa.field("kept_sha256" if digest else "kept", pa.string())
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), last])

    def run(_, slices, later):
        out = [[], [], [], []]
        for row in slices.to_pylist():
            own = Slice(row)
            change = np.zeros(len(own.starts) + 1, np.int32)
            at = own.first[later["doc"].to_numpy()] + later["start"].to_numpy()
            np.add.at(change, at, 1)
            np.add.at(change, at + later["n"].to_numpy() + k - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            keep = np.repeat(~gone, own.ends - own.starts + 1)
            kept, n_gone = own.data[keep].tobytes(), np.r_[0, np.cumsum(gone)]
            sizes = np.r_[0, np.cumsum(np.where(gone, 0, own.ends - own.starts + 1))][own.first].tolist()
            removed = np.diff(n_gone[own.first]).tolist()
            for doc, n, less, a, b in zip(own.ids.tolist(), own.words.tolist(), removed, sizes, sizes[1:]):
                text = kept[a : max(a, b - 1)]
                values = (None if doc == _NO_ID else doc, n, less, hashlib.sha256(text).hexdigest() if digest else text.decode())
                for column, value in zip(out, values):
                    column.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _compacted(docs: DataFrame, id_col: str, text_col: str, window: int, side_bytes: int | None, bits: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, list[str]]]]:
    """Checkpointed slices; and occurrences of paths, the first occurrence of each path that has several, and the columns that name a path."""
    if window < 2 or not 8 <= bits <= 64:
        raise ValueError("a window has two words or more, a key 8 to 64 bits")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    side = side_bytes or min(max(4 << 20, math.isqrt(600 * total)), 128 << 20)
    buckets = max(16, -(-total // side))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (128 << 20)))
    slices = rows.mapInArrow(_slices(side), "ids binary, words binary, ties binary, data binary").withColumn("slice", F.monotonically_increasing_id())
    slices = _dealt(slices, parts)
    listed = slices.mapInArrow(_edges(buckets, window, bits), "bucket int, slice long, single binary, multi binary")
    repeated = listed.groupBy("bucket").applyInArrow(_repeated, "slice long, bucket int, keys binary")
    of_slice = slices.groupBy("slice")
    contexts = of_slice.cogroup(repeated.groupBy("slice")).applyInArrow(_contexts(buckets, window, bits), "bucket int, slice long, keys binary, left binary, right binary")
    junctions = contexts.groupBy("bucket").applyInArrow(_junctions, "slice long, bucket int, keys binary, flags binary")
    paths = checkpointed(of_slice.cogroup(junctions.groupBy("slice")).applyInArrow(_paths(buckets, window, bits), _PATH_SQL))
    first = _first(paths, "path")
    wrong = first.where("digest <> other").select("path")
    if wrong.isEmpty():
        return slices, [(paths, first, ["path"])]
    # different words under one key: the windows of such paths are judged one by one, by their digests alone
    shown = paths.join(wrong, "path", "left_semi").select("slice", "doc", "start", "n")
    windows = checkpointed(of_slice.cogroup(shown.groupBy("slice")).applyInArrow(_windows(window), _PATH_SQL))
    right = paths.join(wrong, "path", "left_anti"), first.where("digest = other"), ["path"]
    return slices, [right, (windows, _first(windows, "path", "digest"), ["path", "digest"])]


def _dealt(slices: DataFrame, parts: int) -> DataFrame:
    """Slices dealt by number and checkpointed, so that cogroups by slice find them in place and shuffle only what they meet.

    A checkpoint keeps the partitioning of a plan that adaptive execution does not change, so that is off for this one step.
    """
    conf, name = slices.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return checkpointed(slices.repartition(parts, "slice"))
    finally:
        conf.set(name, before)


def _first(paths: DataFrame, *keys: str) -> DataFrame:
    """First occurrence of every path that has several, and the range of its digests."""
    ranges = [] if "digest" in keys else [F.min("digest").alias("digest"), F.max("digest").alias("other")]
    found = paths.groupBy(*keys).agg(*ranges, F.min(F.struct("doc_id", "tie", "slice", "doc", "start")).alias("at"), F.count("*").alias("n_found"))
    first = F.struct(*[F.col(f"at.{c}") for c in ("slice", "doc", "start")]).alias("first")
    return checkpointed(found.where("n_found > 1").select(*keys, *[c for c in ("digest", "other") if c not in keys and ranges], first, "n_found"))


def _met(paths: DataFrame, first: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Occurrences of repeated paths, and whether each comes later than the first one of its path; only places are shuffled."""
    own = paths.select(*keys, "slice", "doc", "start", "n", *[c for c in more if c not in keys])
    return own.join(first.select(*keys, "first", "n_found"), keys).withColumn("later", F.struct("slice", "doc", "start") != F.col("first"))


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, digest: bool = False, side_bytes: int | None = None, bits: int = 64) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier in the corpus.

    Earlier is a smaller id, or the same document and an earlier start; windows are judged on the input. 1. Documents are
    packed into slices (checkpointed, dealt by slice once, so that later joins move no text). 2. Edges, the hashes of all
    windows, meet in buckets at a few bytes each; those that occur once are dropped. 3. Each repeated edge's neighbours meet
    in its bucket; it is a junction on a side where they differ or an occurrence begins or ends. 4. Slices cut their walks at
    junctions into occurrences of compacted paths, each with a digest of the words at its source coordinates. 5. All
    occurrences of a path but the first lose their words. A pair of different windows under one key is found by the
    digests; the windows of such paths are then judged one by one, so results do not depend on ``bits``, the width of keys.

    A bucket holds a key at most once for each slice, a group for the first occurrence is a minimum with partial aggregates, and the join
    back is an equi-join that adaptive execution splits. Slices and buckets have 4 MB of text, growing with the root of
    the corpus up to 128 MB.

    Nulls and edge cases: null text has no words; a null id counts as larger than every id; rows with one id are different documents
    in the order of a digest of their words; texts shorter than a window stay; an empty table gives an empty
    result; only the two named columns are read.

    Returns ``doc_id, n_words, n_removed`` and ``kept`` (the remaining words, joined by one space), or with ``digest`` its ``kept_sha256``.
    """
    slices, found = _compacted(docs, id_col, text_col, window, side_bytes, bits)
    later = reduce(DataFrame.unionByName, [_met(*x).where("later").select("slice", "doc", "start", "n") for x in found])
    last = "kept_sha256 string" if digest else "kept string"
    return slices.groupBy("slice").cogroup(later.groupBy("slice")).applyInArrow(_cut(window, digest), f"doc_id long, n_words long, n_removed long, {last}")


def compacted_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, side_bytes: int | None = None, bits: int = 64) -> DataFrame:
    """All occurrences of all compacted paths of repeated windows: ``path`` (32 hexadecimal digits), ``doc_id, start, n_words, n_found, first``.

    ``start`` counts words, ``n_found`` the occurrences of the path, ``first`` marks the earliest. Paths of one repeat overlap by
    ``window`` - 1 words at junctions. Edge cases are those of :func:`remove_repeated_windows`.
    """
    _, found = _compacted(docs, id_col, text_col, window, side_bytes, bits)
    met = reduce(DataFrame.unionByName, [_met(*x, "doc_id", "digest").select("path", "digest", "doc_id", "start", "n", "n_found", "later") for x in found])
    name = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("path", "digest")])
    shown = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id"))
    return met.select(name.alias("path"), shown.alias("doc_id"), "start", (F.col("n") + window - 1).alias("n_words"), "n_found", (~F.col("later")).alias("first"))
