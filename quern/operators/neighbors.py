"""Nearest neighbours: blocked matrix products, so no pair table ever exists."""

from __future__ import annotations

import json
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.contracts import checkpointed
from quern.functions.vectors import dot, normalise
from quern.operators import cells

#: A table with one row a scope is broadcast up to this many rows of under 100 bytes, and joined by a shuffle beyond.
SMALL_ROWS = 100_000
#: A search goes by cells only where bounds leave no more than this share of them.
PRUNED_SHARE = 0.25
#: Stripes that meet in a search of all rows, and the blocks that one may hold.
MOST_STRIPES, MOST_BLOCKS = 16, 25
#: Entries of a matrix that pass the edges and wait to be measured again, at least and at most.
HITS = 1 << 16, 1 << 20
_TYPES = {"long": pa.int64(), "double": pa.float64()}
_BLOCK = "scope string, n_blocks int, block int, ids binary, tags string, v binary"


def _pack(key, rows):
    """A block as one row: ids and vectors as bytes (in single precision, if that loses nothing), tags as JSON."""
    vectors = pa.concat_arrays(rows["v"].chunks).flatten().to_numpy(zero_copy_only=False)
    short = vectors.astype(np.float32)
    kept = b"f" + short.tobytes() if (short == vectors).all() else b"d" + vectors.tobytes()
    columns = [[k.as_py()] for k in key] + [[rows["id"].to_numpy().tobytes()], [json.dumps(rows["tag"].to_pylist())], [kept]]
    schema = pa.schema([("scope", pa.string()), ("n_blocks", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("tags", pa.string()), ("v", pa.binary())])
    return pa.table(columns, schema=schema)


def _parts(n: int, size: int) -> int:
    """One block for up to ``size`` rows, else as many as there are stripes at least: how often a row is sent does not grow with the rows then."""
    return 1 if n <= size else max(MOST_STRIPES, -(-n // size))


def _blocks(rows: DataFrame, size: int, scope: str | None = None, number: int | None = None) -> DataFrame:
    """Rows (id, tag, v) dealt by a hash of the id into blocks of about ``size`` (without a scope, into as many as :func:`_parts` says), within each scope if there is one."""
    rows = rows.where("v IS NOT NULL AND id IS NOT NULL")
    if scope is None:
        rows = rows.withColumns({"scope": F.lit(""), "n_blocks": F.lit(number or _parts(rows.count(), size))})
    else:
        counts = rows.groupBy(F.col("scope").alias("_scope")).agg(F.ceil(F.count("*") / size).cast("int").alias("n_blocks"))
        small = counts.count() <= SMALL_ROWS
        rows = rows.join(F.broadcast(counts) if small else counts, F.col("scope") == F.col("_scope")).drop("_scope")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    return rows.groupBy("scope", "n_blocks", "block").applyInArrow(_pack, _BLOCK)


def _stripes(n_blocks, least: int):
    """How many stripes ``n_blocks`` blocks of a scope form: a fixed number, until a stripe would hold more than MOST_BLOCKS."""
    return F.greatest(F.least(n_blocks, F.lit(least)), F.ceil(n_blocks / MOST_BLOCKS).cast("int"))


def _meetings(left: DataFrame, right: DataFrame, run, schema: str, numbers: DataFrame | None = None, least: int = MOST_STRIPES, once: bool | None = None) -> DataFrame:
    """``run(ids, tags, vectors, other ids, other tags, other vectors)`` for stripes of blocks of ``left`` and ``right`` that share a scope.

    Blocks form stripes by their number, and every stripe of ``left`` meets every one of ``right`` of its scope in one cogroup. So a block is
    sent once for each stripe and not for each block, which grows with the rows, and a task holds two stripes at a time, of MOST_BLOCKS blocks each at most.
    Where the sides have different numbers of blocks, ``numbers`` (``_scope, n_left, n_right``, a small table) says them. ``least`` stripes are formed at least, if
    there are as many blocks: with scopes one is enough, as these meet side by side. With ``once``, which holds where ``left`` is ``right`` too,
    two stripes of one table meet once and not both ways; ``run`` gives the rows of both then.
    """
    once = left is right if once is None else once

    def sent(side, name, own, other, mine, its):
        if numbers is not None:
            side = side.join(F.broadcast(numbers), F.col("scope") == F.col("_scope"))
        stripe = (F.col("block") % _stripes(F.col(mine), least)).alias(own)
        named = [F.col(c).alias(f"{name}_{c}") for c in ("scope", "ids", "tags", "v")]
        moved = side.select(*named, stripe, F.explode(F.sequence(F.lit(0), _stripes(F.col(its), least) - 1)).alias(other))
        moved = moved.where(F.col(f"{name}_i") <= F.col(f"{name}_j")) if once else moved
        return moved.groupBy(f"{name}_scope", f"{name}_i", f"{name}_j")

    def held(table, name):
        table = table.rename_columns([c.removeprefix(name) for c in table.column_names])
        ids = np.concatenate([np.frombuffer(b, np.int64) for b in table["ids"].to_pylist()])
        tags = list(chain.from_iterable(map(json.loads, table["tags"].to_pylist())))
        return ids, tags, np.concatenate([np.frombuffer(b, b[:1].decode(), offset=1).astype(float) for b in table["v"].to_pylist()]).reshape(len(ids), -1)

    names = [f.split()[0] for f in schema.split(", ")]

    def meet(a, b):
        columns = [pa.array([])] * len(names) if not (a.num_rows and b.num_rows) else run(*held(a, "a_"), *held(b, "b_"))
        return pa.table([pa.array(c, _TYPES[f.split()[1]]) for c, f in zip(columns, schema.split(", "))], names=names)

    mine, its = ("n_left", "n_right") if numbers is not None else ("n_blocks", "n_blocks")
    return sent(left, "a", "a_i", "a_j", mine, its).cogroup(sent(right, "b", "b_j", "b_i", its, mine)).applyInArrow(meet, schema)


def _slices(n: int, other: int, cells: int = 1 << 22):
    """Slices of ``n`` rows whose matrix with ``other`` columns has about ``cells`` cells."""
    step = max(1, cells // max(other, 1))
    return (slice(k, k + step) for k in range(0, n, step))


def _sharing(a: list, b: list, sets: bool):
    """A function from slices of ``a`` and ``b`` to which of their rows share a tag: one value each (null equals null), or lists of values (null has none)."""
    a, b = (([t or [] for t in side] if sets else [[t] for t in side]) for side in (a, b))
    if not sets:
        names = {t: i for i, t in enumerate({t for tags in chain(a, b) for t in tags})}
        x, y = (np.array([names[t] for (t,) in side], np.int32) for side in (a, b))
        return lambda rows, others=slice(None): x[rows][:, None] == y[others][None]
    names = {t: i for i, t in enumerate({t for tags in a for t in tags} & {t for tags in b for t in tags})}
    tables = []
    for side in (a, b):
        table = np.zeros((len(side), len(names)), np.float32)
        for row, tags in zip(table, side):
            row[[names[t] for t in tags if t in names]] = 1
        tables.append(table)
    return lambda rows, others=slice(None): tables[0][rows] @ tables[1][others].T > 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def _absolute(x: np.ndarray, y: np.ndarray, tile: int = 2_048) -> np.ndarray:
    """Sums of absolute differences, over tiles that stay in the cache."""
    out, one = np.empty((len(x), len(y)), x.dtype), np.ones(x.shape[1], x.dtype)
    for k in range(0, len(y), tile):
        part = np.ascontiguousarray(y[k : k + tile])
        gap = np.empty_like(part)
        for i, r in enumerate(x):
            np.abs(np.subtract(part, r, out=gap), out=gap)
            np.dot(gap, one, out=out[i, k : k + tile])
    return out


def _closeness(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer: the cosine, or a distance below zero."""
    if metric == "cosine":
        return _unit(x) @ _unit(y).T
    if metric == "euclidean":
        return -np.sqrt(_gaps(x, y))
    if metric == "manhattan":
        return -_absolute(x, y)
    if metric == "geodesic":
        cos = 1 - 2 * _gaps(x, y) / ((1 + (x**2).sum(1))[:, None] * (1 + (y**2).sum(1))[None])
        return -np.arccos(np.clip(cos, -1 + 1e-7, 1 - 1e-7))
    raise ValueError(f"unknown metric {metric}")


def _rough(x: np.ndarray, y: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Both sides in single precision where their scale allows it, and how far two values of :func:`_order` may be off together.

    For the euclidean distance both have two components more, so that one product gives its negative square.
    """
    if metric == "geodesic":
        return x, y, 4e-12
    if metric == "manhattan":
        scale = np.abs(x).sum(axis=1).max() + np.abs(y).sum(axis=1).max()
        ties = 4e-12
    elif metric == "cosine":
        scale, ties = 1.0, 4e-12
    else:
        squares, others = ((v**2).sum(axis=1, keepdims=True) for v in (x, y))
        scale = (np.sqrt(squares.max()) + np.sqrt(others.max())) ** 2
        ties = 8e-12 * np.sqrt(scale)
    single = 1e-20 < scale < 1e20
    slack = 4 * (x.shape[1] + 16) * (1.2e-7 if single else 4e-16) * scale + ties
    kind = np.float32 if single else np.float64
    if metric == "euclidean":
        x, y = np.hstack([2 * x, -squares, np.ones_like(squares)]), np.hstack([y, np.ones_like(others), -others])
    return x.astype(kind), y.astype(kind), float(slack)


def _order(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer, for rows of both sides as :func:`_rough` gives them."""
    if metric == "manhattan" and len(x) > len(y):  # a call for each row of the smaller side
        return np.ascontiguousarray(_closeness(y, x, metric).T)
    return x @ y.T if metric in ("cosine", "euclidean") else _closeness(x, y, metric)


def _exact(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Closeness of single pairs in double precision, distances by differences."""
    out = np.empty(len(r))
    for i in range(0, len(r), 65_536):
        a, b = x[r[i : i + 65_536]], y[c[i : i + 65_536]]
        if metric == "cosine":
            out[i : i + 65_536] = np.einsum("ij,ij->i", a, b)
        elif metric == "euclidean":
            out[i : i + 65_536] = -np.sqrt(((a - b) ** 2).sum(axis=1))
        else:
            out[i : i + 65_536] = -np.abs(a - b).sum(axis=1)
    return out


def _edge(near: np.ndarray, k: int, slack: float) -> np.ndarray:
    """For each row a value below which a column is not among its k largest, from a part of the columns."""
    n = near.shape[1]
    kth = np.partition(near, n - k, axis=1)[:, n - k] if k <= n else np.full(len(near), -np.inf, near.dtype)
    return np.maximum(np.nextafter(kth - slack, -np.inf, dtype=near.dtype), np.finfo(near.dtype).min)


def _places_in(r: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its row; rows are sorted."""
    return np.arange(len(r)) - np.searchsorted(r, r)


class _Best:
    """The k nearest columns of each row so far, measured exactly, and the rough value (``edge``) below which another one is out."""

    def __init__(self, x, y, ids, k, metric, slack, edge):
        self.x, self.y, self.ids, self.k, self.metric, self.slack, self.edge = x, y, ids, k, metric, slack, edge
        self.held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, edge.dtype), np.empty(0)]
        self.hits, self.waiting, self.most = [], 0, min(max(HITS[0], 4 * k * len(x)), HITS[1])

    def add(self, r: np.ndarray, c: np.ndarray, rough: np.ndarray) -> None:
        self.hits.append((r, c, rough))
        self.waiting += len(r)
        if self.waiting > self.most:
            self.settle()

    def settle(self) -> None:
        """Measures those hits again that rounding leaves open, and keeps k a row with those held."""
        if not self.waiting:
            return
        r, c, rough = (np.concatenate(part) for part in zip(*self.hits))
        self.hits, self.waiting = [], 0
        every, values = np.concatenate([self.held[0], r]), np.concatenate([self.held[2], rough])
        order = np.lexsort((-values, every))
        last = order[_places_in(every[order]) == self.k - 1]
        kth = np.full(len(self.x), -np.inf)
        kth[every[last]] = values[last]
        open_ = rough >= kth[r] - self.slack
        r, c, rough = r[open_], c[open_], rough[open_]
        value = rough if self.metric == "geodesic" else _exact(self.x, self.y, r, c, self.metric)
        found = [np.concatenate(pair) for pair in zip(self.held, (r, c, rough, value))]
        order = np.lexsort((self.ids[found[1]], -np.round(found[3], 12), found[0]))
        order = order[_places_in(found[0][order]) < self.k]
        self.held = [part[order] for part in found]
        begins = np.flatnonzero(_places_in(self.held[0]) == 0)
        lowest = np.minimum.reduceat(self.held[2], begins)
        full = np.diff(begins, append=len(order)) == self.k
        rows = self.held[0][begins[full]]
        self.edge[rows] = np.maximum(self.edge[rows], np.nextafter(lowest[full] - self.slack, -np.inf, dtype=self.edge.dtype))

    def rows(self, own: np.ndarray, n_valid: np.ndarray) -> tuple:
        self.settle()
        r, c, _, value = self.held
        return own[r], self.ids[c], value if self.metric == "cosine" else -value, np.where(_places_in(r) == 0, n_valid[r], 0)


def _nearest(k: int, metric: str, rule: str, sets: bool, counted: bool = True, both: bool = False):
    """With ``both``, the nearest of either side are found from one matrix; sides with ids in common are a stripe with itself, whose rows are all on the left.

    The matrix is made in tiles that stay in the cache. What passes the edge of its row or column is collected.
    """

    def run(own, own_tags, x, ids, tags, y):
        if metric == "cosine":
            x, y = _unit(x), _unit(y)
        rough_x, rough_y, slack = _rough(x, y, metric)
        common = bool(len(np.intersect1d(own, ids)))
        shared = _sharing(own_tags, tags, sets) if rule != "any" else None

        def tile(rows, others):
            near = _order(rough_x[rows], rough_y[others], metric)
            if common:
                np.copyto(near, -np.inf, where=own[rows][:, None] == ids[others][None])
            if shared:
                same = shared(rows, others)
                np.copyto(near, -np.inf, where=~same if rule == "same" else same)
            return near

        part = slice(0, max(1_024, 16 * k))
        columns, out = list(_slices(len(ids), 2_048, 1 << 19)), []
        back = n_back = None
        if both and not common:
            edges = [_edge(np.ascontiguousarray(tile(part, others).T), k, slack) for others in columns]
            back, n_back = _Best(y, x, own, k, metric, slack, np.concatenate(edges)), np.zeros(len(ids), np.int64)
        for rows in _slices(len(own), 2_048):
            best = _Best(x[rows], y, ids, k, metric, slack, _edge(tile(rows, part), k, slack))
            n_valid = np.zeros(len(best.x), np.int64)
            for others in columns:
                near = tile(rows, others)
                width = near.shape[1]
                if counted:
                    valid = near > -np.inf
                    n_valid += valid.sum(axis=1)
                at = np.flatnonzero(near >= best.edge[:, None])
                best.add(at // width, at % width + others.start, near.ravel()[at])
                if back:
                    at = np.flatnonzero(near >= back.edge[others][None])
                    back.add(at % width + others.start, at // width + rows.start, near.ravel()[at])
                    if counted:
                        n_back[others] += valid.sum(axis=0)
            out.append(best.rows(own[rows], n_valid))
            if back:
                back.settle()
        if back:
            out.append(back.rows(ids, n_back))
        return [np.concatenate(c) for c in zip(*out)]

    return run


def _slim(rows: DataFrame, key: str, vector: str, tag: str, scope: str | None) -> tuple[DataFrame, bool]:
    sets = dict(rows.dtypes)[tag].startswith("array")
    tags = F.col(tag).cast("array<string>" if sets else "string").alias("tag")
    scoped = [] if scope is None else [F.coalesce(F.col(scope).cast("string"), F.lit("\0")).alias("scope")]
    slim = rows.select(F.col(key).cast("long").alias("id"), tags, F.col(vector).cast("array<double>").alias("v"), *scoped)
    return slim.where("id IS NOT NULL AND v IS NOT NULL").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))), sets


def _best(found: DataFrame, k: int, metric: str, counted: bool) -> DataFrame:
    by = Window.partitionBy("source_id")
    order = F.desc(F.round("value", 12)) if metric == "cosine" else F.asc(F.round("value", 12))
    count = {"candidate_count": F.sum("n_valid").over(by)} if counted else {}
    ranked = found.withColumns({"rank": F.row_number().over(by.orderBy(order, "neighbour_id")), **count})
    return ranked.where(F.col("rank") <= k).select("source_id", "rank", "neighbour_id", "value", *count)


_FOUND = "source_id long, neighbour_id long, value double, n_valid long"


def _by_tag(rows: DataFrame, tag: str) -> DataFrame | None:
    """Rows once for each different value of the array ``tag``, as ``_tag``; None where these meet in more pairs than all rows do."""
    each = rows.withColumn("_tag", F.explode(F.array_distinct(tag)))
    pairs = each.groupBy("_tag").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    return each if pairs <= float(rows.count()) ** 2 else None


def _ranked(rows: DataFrame, key: str, vector: str, tag: str, k: int, metric: str, rule: str, block_rows: int, scope: str | None, counted: bool) -> DataFrame:
    """Every block meets every block of its scope; ``candidate_count``, where it is ``counted``, is how many rows a source could choose from.

    With the rule ``same`` the rows of a tag are a scope; rows with several tags are in several, and a pair that shares more than one counts once.
    """
    twice = False
    if scope is None and rule == "same":
        if not dict(rows.dtypes)[tag].startswith("array"):
            scope, rule = tag, "any"
        elif not counted and (each := _by_tag(rows, tag)) is not None:
            rows, scope, rule, twice = each, "_tag", "any", True
    slim, sets = _slim(rows, key, vector, tag, scope)
    blocks = checkpointed(_blocks(slim, block_rows, scope))
    met = _meetings(blocks, blocks, _nearest(k, metric, rule, sets, counted, True), _FOUND, least=MOST_STRIPES if scope is None else 1)
    if twice:
        met = met.groupBy("source_id", "neighbour_id").agg(F.min("value").alias("value"))
    return _best(met if counted or twice else met.drop("n_valid"), k, metric, counted)


def _cell_packs(rows: DataFrame, packs: dict[int, int]) -> DataFrame:
    """Rows (cell, id, tag, v) packed by a hash of the id into as many blocks as ``packs`` says for their cell.

    The table of cells is small: cells grow with the root of the number of blocks.
    """
    table = rows.sparkSession.createDataFrame(list(packs.items()), "_c int, n_blocks int")
    met = rows.join(F.broadcast(table), F.col("cell") == F.col("_c"))
    packed = met.select(F.col("cell").cast("string").alias("scope"), "n_blocks", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int").alias("block"), "id", "tag", "v")
    return packed.groupBy("scope", "n_blocks", "block").applyInArrow(_pack, _BLOCK)


def _reached(sample: list, pivots: np.ndarray, k: int, metric: str, rule: str, sets: bool) -> float:
    """The share of the cells that the k nearest of a sampled row within the sample leave open."""
    v, ids = np.array([r.v for r in sample], float), np.array([r.id for r in sample])
    points = cells.as_points(v, metric)
    gap = cells.distances(points, pivots, metric)
    radius = np.zeros(len(pivots))
    np.maximum.at(radius, gap.argmin(axis=1), gap.min(axis=1))
    near = _closeness(v, v, metric)
    near[ids[:, None] == ids[None]] = -np.inf
    if rule != "any":
        tags = [r.tag for r in sample]
        same = _sharing(tags, tags, sets)(slice(None))
        near[~same if rule == "same" else same] = -np.inf
    if k >= len(v):
        return 1.0
    kth = np.partition(near, len(v) - k, axis=1)[:, len(v) - k]
    reach = np.sqrt(np.maximum(2 - 2 * kth, 0)) if metric == "cosine" else -kth
    return float((gap - radius[None] <= reach[:, None]).mean())


def _pruned(slim: DataFrame, n: int, k: int, metric: str, rule: str, sets: bool, block_rows: int, meetings: list | None) -> DataFrame | None:
    """As :func:`_ranked` without a scope, but rows meet only the cells whose bound reaches their k-th answer.

    Where a sample shows that bounds leave most cells, as with vectors without clusters, None: all blocks meet in stripes then. Rounds visit 1, 3, 12, 48, ... further cells of a row's order; a row goes on only to cells that may still hold an equal or nearer one.
    """
    n_blocks = -(-n // block_rows)
    sample, pivots = cells.fit(slim, min(n_blocks, max(64, 4 * isqrt(n_blocks))), metric)
    if _reached(sample, pivots, k, metric, rule, sets) > PRUNED_SHARE:
        return None
    dealt = checkpointed(cells.dealt(slim, pivots, metric))
    summary = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("size").alias("size")).collect()
    radius, sizes, largest = {r.cell: r.radius for r in summary}, {r.cell: r.n for r in summary}, max(r.size for r in summary) or 1.0
    in_cell = {c: -(-m // block_rows) for c, m in sizes.items()}
    stored = checkpointed(_cell_packs(dealt, in_cell))
    best, first, beyond = None, 0, 1
    while first < len(radius):
        if best is None:
            asked = dealt.withColumn("worst", F.lit(None).cast("double"))
        else:
            kth = best.where(F.col("rank") == k).select(F.col("source_id").alias("_s"), F.col("value").alias("worst"))
            asked = dealt.join(kth, F.col("id") == F.col("_s"), "left")
        routed = checkpointed(cells.routed(asked, pivots, radius, largest, metric, first, beyond))
        going = {r.cell: r.n for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        if not going:
            break
        if meetings is not None:
            meetings.append(sum(-(-m // block_rows) * in_cell[c] for c, m in going.items()))
        packs = {c: -(-m // block_rows) for c, m in going.items()}
        numbers = slim.sparkSession.createDataFrame([(str(c), m, in_cell[c]) for c, m in packs.items()], "_scope string, n_left int, n_right int")
        met = _meetings(_cell_packs(routed, packs), stored, _nearest(k, metric, rule, sets, False), _FOUND, numbers, 1).drop("n_valid")
        best = checkpointed(_best(met if best is None else best.drop("rank").unionByName(met), k, metric, False))
        first, beyond = beyond, beyond * 4
    return best


def knn(rows: DataFrame, key: str, vector: str, tag: str, k: int, metric: str = "cosine", rule: str = "any", block_rows: int = 2_000, scope: str | None = None, meetings: list | None = None) -> DataFrame:
    """The k nearest other rows of each row, exactly: ``rule`` allows any tag, the ``same`` or an ``other`` one.

    ``tag`` is one value, or an array: ``same`` then asks for a shared value and ``other`` for none. With ``scope`` neighbours have the
    same value of that column. Blocks of rows, packed as bytes, meet blocks of rows of their scope by an equi-join on the block
    number, stripe by stripe; each meeting is matrix products in single precision, from which the pairs that rounding leaves open are measured again in double
    precision, keeps k for each source, and the answers are ranked once more. Without a scope, and with more than one block, where a sample shows
    clusters, blocks lie in cells around pivots and rows meet only the cells that the triangle inequality leaves
    (:mod:`quern.operators.cells`; pivots come from a sample, every row is dealt to its nearest); ``meetings`` collects how many pairs of blocks
    each round has. Ties (to 12 digits) go to the smaller id. Rows without id or vector, or with a null or non-finite component, take no part.
    Returns ``source_id, rank, neighbour_id, value`` (similarity, or distance for the distance metrics).
    """
    if scope is None and metric in cells.PRUNED:
        slim, sets = _slim(rows, key, vector, tag, None)
        n = slim.count()
        found = _pruned(slim, n, k, metric, rule, sets, block_rows, meetings) if n > block_rows else None
        if found is not None:
            return found
    return _ranked(rows, key, vector, tag, k, metric, rule, block_rows, scope, False)


def knn_in_scope(rows: DataFrame, key: str, vector: str, tag: str, scope: str, k: int, metric: str = "cosine", block_rows: int = 2_000) -> DataFrame:
    """The k nearest rows of another tag within each scope, and how many candidates there were; rows without any have one row of rank 0.

    Returns ``source_id, rank, neighbour_id, value, candidate_count``.
    """
    found = _ranked(rows, key, vector, tag, k, metric, "other", block_rows, scope, True)
    sources = rows.select(F.col(key).cast("long").alias("_source")).distinct()
    joined = sources.join(found, F.col("_source") == F.col("source_id"), "left")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rank", "candidate_count")]
    return joined.select(F.col("_source").alias("source_id"), filled[0], "neighbour_id", "value", filled[1])


def _places(own, own_scores, x, ids, _, y):
    scores, x, y = np.round(np.array(own_scores, float), 12), _unit(x), _unit(y)
    place = []
    for rows in _slices(len(own), len(ids)):
        score, mine = np.round(x[rows] @ y.T, 12), scores[rows][:, None]
        before = (score > mine) | ((score == mine) & (ids[None] < own[rows][:, None]))
        place.append((before & (own[rows][:, None] != ids[None])).sum(axis=1))
    return own, np.concatenate(place)


def paired_places(pairs: DataFrame, key: str, first: str, second: str, block_rows: int = 2_000) -> DataFrame:
    """0-based place of each pair's second vector among all second ones by cosine with its first, and the other way round.

    Blocks meet as in :func:`knn`, and each meeting only counts how many are nearer than the pair's own. Equal ones count if their
    id is smaller. Returns ``id, place, reverse_place``.
    """
    x, y = (normalise(F.col(c).cast("array<double>")) for c in (first, second))
    both = pairs.select(F.col(key).cast("long").alias("id"), x.alias("x"), y.alias("y")).withColumn("tag", dot(F.col("x"), F.col("y")))
    out, number = [], _parts(both.count(), block_rows)
    for name, ask, answer in (("place", "x", "y"), ("reverse_place", "y", "x")):
        met = _meetings(*[_blocks(both.select("id", "tag", F.col(c).alias("v")), block_rows, number=number) for c in (ask, answer)], _places, "id long, place long")
        out.append(met.groupBy("id").agg(F.sum("place").alias(name)))
    return out[0].join(out[1], "id")


def wide_neighbours(found: DataFrame, k: int, threshold: float, metric: str = "cosine") -> DataFrame:
    """One row for each source with the neighbours strictly beyond the threshold side by side."""
    beyond = found.where(F.col("value") > threshold if metric == "cosine" else F.col("value") < threshold)
    w = Window.partitionBy("source_id").orderBy("rank")
    beyond = beyond.withColumn("r", F.row_number().over(w))
    columns = [c for r in range(1, k + 1) for c in (F.max(F.when(F.col("r") == r, F.col("neighbour_id"))).alias(f"top{r}_id"), F.max(F.when(F.col("r") == r, F.col("value"))).alias(f"top{r}_value"))]
    return beyond.groupBy("source_id").agg(*columns)


def _pack_category(key, rows):
    """A block of one category as one row; vectors of other lengths are filled up with zeros, null ones have length -1."""
    given = rows["v"].to_pylist()
    whole = [v is not None and None not in v for v in given]
    width = max([len(v) for v, w in zip(given, whole) if w], default=0)
    vectors, sizes = np.zeros((len(given), width)), np.full(len(given), -1, np.int64)
    for i, (v, w) in enumerate(zip(given, whole)):
        if w:
            vectors[i, : len(v)], sizes[i] = v, len(v)
    columns = [[key[0].as_py()], [key[1].as_py()], [key[2].as_py()], [rows["id"].to_numpy().tobytes()], [sizes.tobytes()], [vectors.tobytes()]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [rows["c"].type, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])], names=["c", "n_blocks", "block", "ids", "sizes", "v"])


def _category_pairs(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            (ids, sizes, x), (others, other_sizes, y) = [
                (np.frombuffer(row[f"{s}_ids"], np.int64), np.frombuffer(row[f"{s}_sizes"], np.int64), np.frombuffer(row[f"{s}_v"]).reshape(len(row[f"{s}_ids"]) // 8, -1)) for s in "ab"
            ]
            width = max(x.shape[1], y.shape[1])
            x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
            same = row["a_block"] == row["b_block"]
            for rows in _slices(len(ids), len(others)):
                cosine = x[rows] @ y.T
                kept = np.flatnonzero(ids[rows][:, None] < others[None] if same else ids[rows][:, None] != others[None])
                kept = kept[np.argsort(cosine.ravel()[kept])]
                for k in range(0, len(kept), 1 << 19):
                    some = kept[k : k + (1 << 19)]
                    r, c = some // len(others) + rows.start, some % len(others)
                    void = (sizes[r] != other_sizes[c]) | (sizes[r] < 0)
                    a, b = ids[r], others[c]
                    columns = [pa.repeat(batch.column("c")[at], len(r)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cosine.ravel()[some], mask=void)]
                    yield pa.RecordBatch.from_arrays(columns, names=["c", "a", "b", "cosine"])


def pairs_within(rows: DataFrame, key: str, category: str, vector: str, block_rows: int = 2_000) -> DataFrame:
    """Unordered pairs of each category with their cosine: the pair table itself is the result asked for.

    Blocks of a category meet by an equi-join on the block number, each two of them once; a meeting is one matrix product whose pairs leave in
    batches of bounded size, so what moves are blocks. Up to four million pairs at a time leave in the order of their cosine: rounded ones are equal in many rows then,
    which keeps files small, where the cosine is most of a row. Blocks grow to 8 times ``block_rows`` so that there are few. Keys are long.
    """
    unit = rows.where(F.col(category).isNotNull() & F.col(key).isNotNull())
    unit = unit.select(F.col(category).alias("c"), F.col(key).cast("long").alias("id"), normalise(F.col(vector).cast("array<double>")).alias("v"))
    n = F.count("*")
    counts = unit.groupBy(F.col("c").alias("_c")).agg(F.greatest(F.ceil(n / (8 * block_rows)), F.least(F.ceil(n / block_rows), F.lit(16))).cast("int").alias("n_blocks"))
    dealt = unit.join(counts, F.col("c") == F.col("_c")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    kind = dict(unit.dtypes)["c"]
    blocks = checkpointed(dealt.select("c", "n_blocks", "block", "id", "v").groupBy("c", "n_blocks", "block").applyInArrow(_pack_category, f"c {kind}, n_blocks int, block int, ids binary, sizes binary, v binary"))
    packed = ("block", "ids", "sizes", "v")
    a = blocks.select("c", F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("_at"), *[F.col(p).alias(f"a_{p}") for p in packed])
    b = blocks.select(F.col("c").alias("_c"), *[F.col(p).alias(f"b_{p}") for p in packed])
    met = a.join(b.hint("shuffle_hash"), (F.col("c") == F.col("_c")) & (F.col("_at") == F.col("b_block"))).drop("_c", "_at")
    return met.mapInArrow(_category_pairs, f"c {kind}, a long, b long, cosine double").withColumnRenamed("c", category)


def triplets(rows: DataFrame, key: str, vector: str, tag: str, block_rows: int = 2_000, scope: str | None = None) -> DataFrame:
    """Best positive (same tag) and hardest negative (other tag) of each row, with a status when one lacks.

    ``tag`` may be an array of labels: a positive shares one, a negative shares none. ``scope`` restricts negatives to rows
    with the anchor's value of that column, such as its parent class.
    """
    positive = knn(rows, key, vector, tag, 1, rule="same", block_rows=block_rows).select(F.col("source_id").alias("_p"), F.col("neighbour_id").alias("positive_id"), F.col("value").alias("positive_value"))
    negative = knn(rows, key, vector, tag, 1, rule="other", block_rows=block_rows, scope=scope)
    negative = negative.select(F.col("source_id").alias("_n"), F.col("neighbour_id").alias("negative_id"), F.col("value").alias("negative_value"))
    anchors = rows.select(F.col(key).alias("anchor_id"), F.col(tag).alias("label"))
    found = anchors.join(positive, F.col("anchor_id") == F.col("_p"), "left").join(negative, F.col("anchor_id") == F.col("_n"), "left")
    status = F.when(F.col("positive_id").isNull(), "no_positive").when(F.col("negative_id").isNull(), "no_hard_negative").otherwise("ok")
    return found.select("anchor_id", "label", "positive_id", "positive_value", "negative_id", "negative_value", status.alias("status"))


_SUMS = "source_id long, mass double, positive_sum double, n_positive long, negative_sum double, n_negative long"


def _pair_sums(tau: float, metric: str, sets: bool):
    def run(own, own_tags, x, ids, tags, y):
        if metric == "cosine":
            x, y = _unit(x), _unit(y)
        common, shared = bool(len(np.intersect1d(own, ids))), _sharing(own_tags, tags, sets)
        # rows of one id lie in one stripe, so ids in common mean a stripe with itself, where each pair comes both ways
        out, back = [], np.zeros((5, len(ids)))
        for rows in _slices(len(own), len(ids), 1 << 20):
            near = x[rows] @ y.T if metric == "cosine" else _closeness(x[rows], y, metric)
            mass = (near - (metric == "cosine")) / tau
            np.exp(mass, out=mass)
            same = shared(rows)
            other = ~same
            if common:
                itself = own[rows][:, None] == ids[None]
                mass[itself], near[itself], same[itself], other[itself] = 0.0, 0.0, False, False
            positive = near * same
            near -= positive
            parts = (mass, positive, same, near, other)
            out.append((own[rows], *[p.sum(axis=1) for p in parts]))
            if not common:
                back += [p.sum(axis=0) for p in parts]
        found = [np.concatenate(c) for c in zip(*out)]
        if common:
            return found
        back = [ids, back[0], back[1], back[2].astype(np.int64), back[3], back[4].astype(np.int64)]
        return [np.concatenate(c) for c in zip(found, back)]

    return run


def contrastive_sums(rows: DataFrame, key: str, vector: str, tag: str, tau: float, block_rows: int = 2_000, metric: str = "cosine") -> DataFrame:
    """For every row the log of the summed exp(closeness / tau) over all others, and sum and count of its same-tag and other-tag closeness.

    Closeness is the cosine, or a distance below zero (``euclidean``, ``manhattan``, ``geodesic``). Blocks meet blocks as in
    :func:`knn`, two stripes once; each meeting gives one partial sum a row of either side, merged by an aggregate.
    """
    slim, sets = _slim(rows, key, vector, tag, None)
    blocks = checkpointed(_blocks(slim, block_rows))
    parts = _meetings(blocks, blocks, _pair_sums(tau, metric, sets), _SUMS, once=True)
    kept = ("positive_sum", "n_positive", "negative_sum", "n_negative")
    sums = parts.groupBy("source_id").agg(F.sum("mass").alias("m"), *[F.sum(c).alias(c) for c in kept])
    return sums.select("source_id", (F.log("m") + (1 / tau if metric == "cosine" else 0.0)).alias("log_mass"), *kept)


def batch_positives(rows: DataFrame, batch: str, key: str, tag: str, vector: str) -> DataFrame:
    """In every batch each anchor's one positive (same tag) and hardest negative; batches are bounded, so pairs within one are too.

    An anchor without exactly one positive is an error of the running job.
    """
    unit = rows.select(batch, F.col(key).alias("a"), F.col(tag).alias("ta"), normalise(F.col(vector).cast("array<double>")).alias("_x"))
    other = unit.select(F.col(batch).alias("_b"), F.col("a").alias("b"), F.col("ta").alias("tb"), F.col("_x").alias("_y"))
    met = unit.join(other, (F.col(batch) == F.col("_b")) & (F.col("a") != F.col("b"))).withColumn("s", dot(F.col("_x"), F.col("_y")))
    same = F.col("ta") == F.col("tb")
    found = met.groupBy(batch, "a").agg(
        F.count_if(same).alias("n"), F.max(F.when(same, F.col("b"))).alias("positive"), F.max_by("b", F.when(~same, F.struct(F.round("s", 12), -F.col("b")))).alias("negative")
    )
    return found.select(batch, "a", F.when(F.col("n") == 1, F.col("positive")).otherwise(F.raise_error(F.lit("anchor without exactly one positive")).cast("long")).alias("positive"), "negative")
