"""Exact removal of repeated byte strings: enhanced suffix arrays over anchors, one array for each bucket of anchors.

Every string of ``least`` bytes has one anchor, the rightmost smallest of its 26-byte grams by hash, so equal strings
have equal anchors at equal places. The anchors split the suffixes of the corpus into buckets that hold all
occurrences of a string, and only anchors that two documents share go on.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, mix64, text_slices

_C = np.random.default_rng(50).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
_REM = np.uint64((1 << 40) - 1)
_NO_ID = (1 << 63) - 1
GRAM = 26
_PAD = 0xFF


def _zip(array: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(array).tobytes())


def _unzip(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def _zip_sorted(keys: np.ndarray) -> bytes:
    """Sorted 40-bit keys as byte planes of their differences."""
    return _zip(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unzip_sorted(raw: bytes) -> np.ndarray:
    planes = _unzip(raw, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def anchors(data: np.ndarray, offsets: np.ndarray, least: int = 50) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one anchor: first and last start, anchor, anchor's hash, row."""
    none = np.zeros(0, np.int64)
    n, width = len(data), least - GRAM + 1
    if n < least:
        return none, none, none, none.astype(np.uint64), none
    words = np.lib.stride_tricks.as_strided(data, (n - 7, 8), (1, 1)).copy().view("<u8").ravel()
    m = n - GRAM + 1
    h = words[:m] * _C[0]
    for c, at in zip(_C[1:4], (8, 16, GRAM - 8)):
        h += words[at : at + m] * c
    h = mix64(h)
    low = (h & ~_LOW) | (_LOW - np.arange(m, dtype=np.uint64))
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    change = np.zeros(n + 1, np.int32)
    lengths = np.diff(offsets)
    long_ = lengths >= least
    np.add.at(change, offsets[:-1][long_], 1)
    np.add.at(change, offsets[1:][long_] - least + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[: n - least + 1]) > 0)
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none
    at = (_LOW - (low[starts] & _LOW)).astype(np.int64)
    cut = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(starts)] - 1
    q0, q1, p = starts[first], starts[last], at[first]
    return q0, q1, p, h[p], np.searchsorted(offsets, q0, side="right") - 1


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper 24 bits, 40 bits of the hash below."""
    return (((h >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40)) | (mix64(h + _C[5]) & _REM)


def _slices(max_bytes: int):
    """Documents packed into slices of about ``max_bytes``: ids, lengths and compressed bytes."""
    schema = pa.schema([("ids", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, offsets in text_slices(batch.column("text"), max_bytes):
                own = ids[row : row + len(offsets) - 1]
                columns = [pa.array([x], pa.binary()) for x in (own.tobytes(), np.diff(offsets).astype(np.int64).tobytes(), _zip(data, 3))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
    return ids, np.r_[0, np.cumsum(lengths)], _unzip(row["data"], np.uint8)


def _parts(offsets: np.ndarray, max_bytes: int = 1 << 19):
    """Runs of whole rows of about ``max_bytes``."""
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1)
        yield row, end
        row = end


def _count(buckets: int, least: int):
    """For every bucket the slice's anchors, once for each that one document has and with counts for those of several."""
    schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("single", pa.binary()), ("multi", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, offsets, data = _open(row)
                found = []
                for a, b in _parts(offsets):
                    _, _, _, h, doc = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least)
                    if len(h):
                        key = _keys(h, buckets)
                        order = np.lexsort((key, doc))
                        key, doc = key[order], doc[order]
                        found.append(key[np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]])
                if not found:
                    continue
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                own = (keys >> np.uint64(40)).astype(np.int64)
                cuts = np.searchsorted(own, np.arange(buckets + 1))
                out = [[], [], [], [], []]
                for k in np.flatnonzero(np.diff(cuts)):
                    part, n = keys[cuts[k] : cuts[k + 1]] & _REM, counts[cuts[k] : cuts[k + 1]]
                    values = (int(k), row["slice"], _zip_sorted(part[n == 1]), _zip_sorted(part[n > 1]), _zip(n[n > 1].astype(np.uint32)))
                    for column, value in zip(out, values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _shared(hot: int):
    """For every slice the anchors of this bucket that two documents or more have; those of over ``hot`` apart."""

    def run(key, rows):
        slices, keys, counts, owner = rows["slice"].to_pylist(), [], [], []
        for i, (single, multi, n) in enumerate(zip(rows["single"], rows["multi"], rows["counts"])):
            one, many = _unzip_sorted(single.as_py()), _unzip_sorted(multi.as_py())
            keys += [one, many]
            counts += [np.ones(len(one), np.int64), _unzip(n.as_py(), np.uint32).astype(np.int64)]
            owner += [np.full(len(one) + len(many), i, np.int64)]
        keys, counts, owner = np.concatenate(keys), np.concatenate(counts), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        keys, counts, owner = keys[order], counts[order], owner[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.repeat(np.add.reduceat(counts, first), np.diff(np.r_[first, len(keys)]))
        out = {"slice": [], "bucket": [], "cold": [], "hot": []}
        warm, much = (total > 1) & (total <= hot), total > hot
        by_owner = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by_owner], np.arange(len(slices) + 1))
        for i, s in enumerate(slices):
            mine = by_owner[cuts[i] : cuts[i + 1]]
            cold, fire = np.sort(keys[mine[warm[mine]]]), np.sort(keys[mine[much[mine]]])
            if len(cold) + len(fire):
                out["slice"].append(s), out["bucket"].append(key[0].as_py())
                out["cold"].append(_zip_sorted(cold)), out["hot"].append(_zip_sorted(fire))
        return pa.table(out, schema=pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("cold", pa.binary()), ("hot", pa.binary())]))

    return run


_ROW = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("rows", pa.binary()), ("bytes", pa.binary()), ("done", pa.binary())])
_STRING = np.dtype([("id", "<i8"), ("doc", "<u4"), ("q0", "<u4"), ("far", "u1"), ("near", "u1"), ("copies", "<u4")])
_SPAN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("end", "<u4")])


def _member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return of[at] == keys


def _strings(buckets: int, least: int):
    """The strings around a slice's shared anchors, sent to the anchor's bucket once for each content.

    A later document of the slice with the same content is settled here. Around a hot anchor each string
    of ``least`` bytes goes by its own hash, so that what differs spreads and what is equal goes once.
    """

    def run(key, slices, shared):
        number = key[0].as_py()
        out: dict[int, list] = {}
        done = []
        for row in slices.to_pylist():
            ids, offsets, data = _open(row)
            sets = {name: [] for name in ("cold", "hot")}
            for bucket, *raw in zip(*(shared[c].to_pylist() for c in ("bucket", "cold", "hot"))):
                for name, x in zip(sets, raw):
                    sets[name].append(_unzip_sorted(x) | (np.uint64(bucket) << np.uint64(40)))
            cold, hot = (np.sort(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in sets.values())
            if not len(cold) + len(hot):
                continue
            parts = []
            for a, b in _parts(offsets):
                base = offsets[a]
                q0, q1, p, h, doc = anchors(data[base : offsets[b]], offsets[a : b + 1] - base, least)
                keys = _keys(h, buckets)
                c, f = np.flatnonzero(_member(keys, cold)), np.flatnonzero(_member(keys, hot))
                parts.append(np.stack([q0[c] + base, q1[c] + base, p[c] + base, doc[c] + a, (keys[c] >> np.uint64(40)).astype(np.int64)]))
                if len(f):
                    n = q1[f] - q0[f] + 1
                    q = np.repeat(q0[f], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base
                    own = np.zeros(len(q), np.uint64)
                    for k in range(0, least, 2):
                        own = (own ^ (data[q + k].astype(np.uint64) * np.uint64(256) + data[q + k + 1])) * _C[6]
                    parts.append(np.stack([q, q, q, np.repeat(doc[f] + a, n), (mix64(own) % np.uint64(buckets)).astype(np.int64)]))
            q0, q1, p, doc, bucket = np.concatenate(parts, axis=1)
            order = np.lexsort((q0, ids[doc]))
            raw, seen, keep, copies = data.tobytes(), {}, [], np.zeros(len(q0), np.uint32)
            for i, a, b, c, d in zip(order.tolist(), q0[order].tolist(), (q1[order] + least).tolist(), p[order].tolist(), doc[order].tolist()):
                content = (raw[a:b], c - a)
                least_id, at = seen.setdefault(content, (ids[d], i))
                copies[at] += 1
                if least_id < ids[d]:
                    done.append((d, a - offsets[d], b - offsets[d]))
                else:
                    copies[i] += at != i
                    keep.append(i)
            del seen
            keep = np.array(keep, np.int64)
            keep = keep[np.argsort(bucket[keep], kind="stable")]
            cuts = np.searchsorted(bucket[keep], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                i = keep[cuts[k] : cuts[k + 1]]
                rows = np.zeros(len(i), _STRING)
                rows["id"], rows["doc"], rows["q0"] = ids[doc[i]], doc[i], q0[i] - offsets[doc[i]]
                rows["far"], rows["near"], rows["copies"] = p[i] - q0[i], p[i] - q1[i], copies[i]
                text = b"".join([raw[a:b] for a, b in zip(q0[i].tolist(), (q1[i] + least).tolist())])
                out.setdefault(int(k), []).append((rows, text))
        columns = [[], [], [], [], []]
        spans = np.array(done, _SPAN) if done else np.zeros(0, _SPAN)
        home = int(mix64(np.array([number], np.uint64))[0] % np.uint64(buckets))
        for k in sorted(out.keys() | ({home} if done else set())):
            rows = np.concatenate([r for r, _ in out[k]]) if k in out else np.zeros(0, _STRING)
            text = np.frombuffer(b"".join(t for _, t in out.get(k, ())), np.uint8)
            for column, value in zip(columns, (k, number, _zip(rows), _zip(text, 5), _zip(spans) if k == home else None)):
                column.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ROW)], schema=_ROW)

    return run


def _words(matrix: np.ndarray) -> list[np.ndarray]:
    """Columns of eight bytes as big-endian numbers, for sorting rows of bytes."""
    wide = np.zeros((len(matrix), -(-matrix.shape[1] // 8) * 8), np.uint8)
    wide[:, : matrix.shape[1]] = matrix
    return [np.ascontiguousarray(wide[:, k : k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, wide.shape[1], 8)]


def _sorted_prefixes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of the rows and each one's common prefix with the row before it."""
    order = np.lexsort(_words(matrix)[::-1])
    common = np.zeros(len(order), np.int16)
    for k in range(0, len(order), 1 << 16):
        part = matrix[order[max(k - 1, 0) : k + (1 << 16)]]
        same = part[1:] == part[:-1]
        length = np.where(same.all(axis=1), matrix.shape[1], same.argmin(axis=1))
        common[max(k, 1) : max(k, 1) + len(length)] = length
    return order, common


def _range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs of 1, 2, 4, ... neighbours."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def _least_in(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first] to values[last] for every pair, from two overlapping runs."""
    out = np.empty(len(first), np.int64)
    level = np.frexp(last - first + 1)[1] - 1
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(levels[k][first[at]], levels[k][last[at] - (1 << int(k)) + 1])
    return out


def lcp_intervals(common: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """Stack-scan of common-prefix lengths: every interval of depth >= least as (depth, depth of its parent, first, last).

    ``common[i]`` belongs to sorted rows i - 1 and i. An interval is a maximal run of rows that share ``depth`` bytes; intervals
    nest as the internal nodes of the prefix tree do. Parents below ``least`` count as least - 1.
    """
    out, stack = [], []  # of (depth, first)
    for i, depth in enumerate([*common[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            own, first = stack.pop()
            out.append((own, max(depth, stack[-1][0] if stack else 0, least - 1), first, i - 1))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


class SuffixBucket:
    """The enhanced suffix array of one bucket: suffixes from the anchors on, and the bytes before them read backwards.

    Places beyond a row's own string hold ``_PAD``, which no UTF-8 text has.
    """

    def __init__(self, rows: np.ndarray, text: np.ndarray, least: int):
        self.rows, self.least, self.width = rows, least, least - GRAM + 1
        far, near = rows["far"].astype(np.int64), rows["near"].astype(np.int64)
        begin = np.cumsum(far - near + least) - (far - near + least)
        after, before = np.arange(least), np.arange(1, self.width)
        padded = np.r_[text, np.zeros(least + 1, np.uint8)]
        tail = padded[np.minimum((begin + far)[:, None] + after, len(padded) - 1)]
        tail[after[None, :] >= (least - near)[:, None]] = _PAD
        left = padded[np.maximum((begin + far)[:, None] - before, 0)]
        left[before[None, :] > far[:, None]] = _PAD
        self.far, self.room = far, least - near
        self.order, self.common = _sorted_prefixes(tail)
        self.left_order, self.left_common = _sorted_prefixes(left)
        found = lcp_intervals(self.common.tolist(), GRAM)
        self.depth, self.parent, self.first, self.last = np.array(found, np.int64).reshape(-1, 4).T

    def maximal(self, most: int = 1 << 18):
        """Yield all maximal repeats in batches: bytes before the anchor, bytes from it on, first and last member, and the rows that these index.

        The rows of each suffix interval are put in order of their left contexts, for about ``most`` rows of intervals at once. A second
        stack-scan, over their common left contexts, gives every group of rows with one left extension at which the next ones
        differ (left-diverse). It is right-diverse unless all its rows lie in one child interval, which then reports them.
        Every string of ``least`` bytes that several rows hold is part of just one maximal repeat with exactly these rows.
        """
        if not len(self.depth):
            return
        rank, place = np.empty(len(self.rows), np.int64), np.empty(len(self.rows), np.int64)
        rank[self.left_order], place[self.order] = np.arange(len(rank)), np.arange(len(place))
        left, right = (_range_minima(x.astype(np.uint8)) for x in (self.left_common, self.common))
        sizes = self.last - self.first + 1
        for own in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1):
            size, depth = sizes[own], self.depth[own]
            node = np.repeat(np.arange(len(own)), size)
            rows = self.order[np.repeat(self.first[own] - (np.cumsum(size) - size), size) + np.arange(len(node))]
            rows = rows[np.lexsort((rank[rows], node))]
            inner = np.flatnonzero(node[1:] == node[:-1])
            joint = np.zeros(len(rows), np.int64)  # 0 between intervals, else one more than the common left context
            joint[inner + 1] = 1 + _least_in(left, rank[rows[inner]] + 1, rank[rows[inner + 1]])
            back, _, i, j = np.array(lcp_intervals(joint.tolist(), 1), np.int64).reshape(-1, 4).T
            depth = depth[node[i]]
            low, high = _least_in(_range_minima(place[rows]), i, j), -_least_in(_range_minima(-place[rows]), i, j)
            diverse = _least_in(right, low + 1, high) == depth
            back, depth = np.minimum(back - 1, _least_in(_range_minima(self.far[rows]), i, j)), np.minimum(depth, _least_in(_range_minima(self.room[rows]), i, j))
            ok = diverse & (back + depth >= self.least)
            yield back[ok], depth[ok], i[ok], j[ok], rows


def _repeats(least: int):
    """Spans of strings that a smaller document also has, for every slice."""
    schema = pa.schema([("slice", pa.int64()), ("spans", pa.binary())])

    def run(key, table):
        rows, texts, slices, spans = [], [], [], {}
        for s, r, t, d in zip(*(table[c].to_pylist() for c in ("slice", "rows", "bytes", "done"))):
            r = _unzip(r, _STRING)
            rows.append(r), texts.append(_unzip(t, np.uint8)), slices.append(np.full(len(r), s, np.int64))
            if d is not None:
                spans.setdefault(s, []).append(_unzip(d, _SPAN))
        rows, text, slices = np.concatenate(rows), np.concatenate(texts), np.concatenate(slices)
        if len(rows):
            width = least - GRAM + 1
            rank = np.empty(len(rows), np.int64)
            by_id = np.argsort(rows["id"], kind="stable")
            rank[by_id] = np.cumsum(np.r_[0, np.diff(rows["id"][by_id]) != 0])
            change = np.zeros(len(rows) * (width + 2), np.int16)
            for back, depth, i, j, members in SuffixBucket(rows, text, least).maximal():
                first_id, size = _least_in(_range_minima(rank[members]), i, j), j - i + 1
                for g in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(size) >> 20)) + 1):
                    n = size[g]
                    own = members[np.repeat(i[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    later = np.flatnonzero(rank[own] > np.repeat(first_id[g], n))
                    own, group = own[later] * (width + 2), np.repeat(g, n)[later]
                    np.add.at(change, own + width - back[group], 1)
                    np.add.at(change, own + width - least + depth[group] + 1, -1)
            gone = np.cumsum(change.reshape(-1, width + 2), axis=1, dtype=np.int16) > 0
            r, c = np.nonzero(gone[:, 1:] != gone[:, :-1])
            i, a, b = r[::2], c[::2], c[1::2]
            found = np.zeros(len(i), _SPAN)
            anchor = rows["q0"][i].astype(np.int64) + rows["far"][i]
            found["doc"], found["start"], found["end"] = rows["doc"][i], anchor - (width - (a + 1)), anchor - (width - b) + least
            for s in np.unique(slices[i]):
                spans.setdefault(int(s), []).append(found[slices[i] == s])
        out = [(s, _zip(np.concatenate(x))) for s, x in sorted(spans.items())]
        return pa.table([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _groups(least: int):
    """Maximal repeat groups of a bucket with all their occurrences."""
    schema = pa.schema([("group", pa.int64()), ("length", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("copies", pa.int64())])

    def run(key, table):
        rows = np.concatenate([np.zeros(0, _STRING), *(_unzip(r, _STRING) for r in table["rows"].to_pylist())])
        text = np.concatenate([np.zeros(0, np.uint8), *(_unzip(t, np.uint8) for t in table["bytes"].to_pylist())])
        out = [[], [], [], [], []]
        if len(rows):
            bucket = SuffixBucket(rows, text, least)
            alone = np.flatnonzero(rows["copies"] > 1)  # a row that stands for several copies is a repeat of its whole string by itself
            batches = [(bucket.far[alone], bucket.room[alone], np.arange(len(alone)), np.arange(len(alone)), alone)]
            number = key[0].as_py() << 38
            for back, depth, i, j, members in chain(batches, bucket.maximal()):
                for k in range(len(i)):
                    own = rows[members[i[k] : j[k] + 1]]
                    starts = own["q0"].astype(np.int64) + own["far"] - back[k]
                    for column, values in zip(out, ([number] * len(own), [int(back[k] + depth[k])] * len(own), own["id"].tolist(), starts.tolist(), own["copies"].tolist())):
                        column += values
                    number += 1
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _finish(key, slices, found):
    """Count and cut the covered bytes of every document of a slice."""
    out = [[], [], [], [], []]
    for row in slices.to_pylist():
        ids, offsets, data = _open(row)
        change = np.zeros(len(data) + 1, np.int32)
        for raw in found["spans"].to_pylist():
            spans = _unzip(raw, _SPAN)
            np.add.at(change, offsets[spans["doc"]] + spans["start"], 1)
            np.add.at(change, offsets[spans["doc"]] + spans["end"], -1)
        covered = np.cumsum(change[:-1]) > 0
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = covered[offsets[:-1][offsets[:-1] < len(data)]]
        kept, n_gone, n_runs = data[~covered].tobytes(), np.r_[0, np.cumsum(covered)], np.r_[0, np.cumsum(begins)]
        for k, doc in enumerate(ids.tolist()):
            a, b = int(offsets[k]), int(offsets[k + 1])
            text = kept[a - int(n_gone[a]) : b - int(n_gone[b])]
            values = (None if doc == _NO_ID else doc, b - a, int(n_gone[b] - n_gone[a]), int(n_runs[b] - n_runs[a]), text)
            for column, value in zip(out, values):
                column.append(value)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    return pa.table([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def _digest(key, slices, found):
    table = _finish(key, slices, found)
    sums = pa.array([hashlib.sha256(x).hexdigest() for x in table["kept"].to_pylist()], pa.string())
    return table.drop_columns(["kept"]).append_column("kept_sha256", sums)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, digest: bool = False, slice_bytes: int | None = None, bucket_bytes: int | None = None, hot: int = 500) -> DataFrame:
    """Remove every byte covered by a ``least``-byte string that also starts in a document with a smaller id.

    1. Documents are packed into compressed slices of about ``slice_bytes`` (checkpointed), and each slice lists the
       anchors of its strings. 2. Anchors meet in buckets; those of one document are dropped, at a few bytes each.
    3. Slices send the strings around shared anchors to the anchors' buckets, once for each content and slice; strings at an anchor
       of over ``hot`` documents go by their own hash, so no bucket collects a common passage. 4. Each bucket sorts its suffixes, and the
       common-prefix intervals with diverse left extensions are the maximal repeat groups (:meth:`SuffixBucket.maximal`). In each
       group all members but those with the smallest id lose the repeat's bytes. 5. The covered spans return to the slices. A task
    holds one slice or one bucket. By default both are 8 MB, beyond 54 GB of text the root of 1300 times its bytes, so that a slice still sends a bucket some hundred anchors at once.

    Nulls and edge cases: null text is empty; a null id counts as larger than every id; rows with one id
    remove nothing from each other; strings are judged on the input; texts shorter than ``least`` keep everything; an empty
    table gives an empty result; only the two named columns are read.

    Returns ``doc_id, n_bytes, n_removed, n_spans`` and ``kept`` (the remaining bytes), or with ``digest`` their ``kept_sha256``.
    """
    slices, strings = _anchored_strings(docs, id_col, text_col, least, slice_bytes, bucket_bytes, hot)
    spans = strings.groupBy("bucket").applyInArrow(_repeats(least), "slice long, spans binary")
    last = "kept_sha256 string" if digest else "kept binary"
    return slices.groupBy("slice").cogroup(spans.groupBy("slice")).applyInArrow(_digest if digest else _finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, slice_bytes: int | None = None, bucket_bytes: int | None = None, hot: int = 500) -> DataFrame:
    """Maximal repeat groups of at least ``least`` bytes, with all occurrences.

    A group is an interval of an anchor's suffixes with one left extension, diverse on both sides within the strings around the
    anchor; a repeat longer than those appears once for each of its anchors (at a hot anchor, for each start). An occurrence
    stands for all documents of its slice with the very same string around it, ``copies`` counts them, the smallest id names
    them; so a common passage costs a row for each slice. Edge cases are those of :func:`remove_repeats`.

    Returns ``group, length, doc_id, start, copies`` (start in bytes).
    """
    _, strings = _anchored_strings(docs, id_col, text_col, least, slice_bytes, bucket_bytes, hot)
    return strings.groupBy("bucket").applyInArrow(_groups(least), "group long, length int, doc_id long, start long, copies long")


def _anchored_strings(docs: DataFrame, id_col: str, text_col: str, least: int, slice_bytes: int | None, bucket_bytes: int | None, hot: int) -> tuple[DataFrame, DataFrame]:
    """Checkpointed slices, and the strings around shared anchors in their buckets."""
    if least < GRAM + 8:
        raise ValueError(f"least must be {GRAM + 8} or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    side = max(8 << 20, math.isqrt(1300 * total))
    slices = rows.mapInArrow(_slices(slice_bytes or side), "ids binary, lengths binary, data binary")
    slices = checkpointed(slices.withColumn("slice", F.monotonically_increasing_id()))
    buckets = max(256, -(-total // (bucket_bytes or side)))
    counted = slices.mapInArrow(_count(buckets, least), "bucket int, slice long, single binary, multi binary, counts binary")
    shared = counted.groupBy("bucket").applyInArrow(_shared(hot), "slice long, bucket int, cold binary, hot binary")
    strings = slices.groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(_strings(buckets, least), "bucket int, slice long, rows binary, bytes binary, done binary")
    return slices, strings
