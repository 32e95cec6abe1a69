"""Exact top-k search by inner product: pivot cells, and in their blocks M-trees searched best-first."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed


#: The score of an empty place, below all scores.
NONE = -(1 << 62)


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - centre) ** 2).sum(axis=1), 0.0))


class MTree:
    """Paged metric tree: each entry of a page has a centre, a covering radius and its distance to the page's own centre.

    Vectors are lifted by one coordinate to equal norms, so that nearer in Euclidean distance is a larger inner product.
    ``pages[i]`` is (is leaf, parent distances, radii, children or ids, lifted points, integer vectors of a leaf).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm2: float, page: int = 64):
        lift = np.sqrt(np.maximum(norm2 - (vectors.astype(float) ** 2).sum(axis=1), 0.0))
        self.points, self.vectors, self.ids, self.norm2, self.page = np.column_stack([vectors.astype(float), lift]), vectors, ids, norm2, page
        self.pages: list = []
        order = np.argsort(ids, kind="stable")
        self.root, self.centre, self.radius = self._build(order)

    def _build(self, rows: np.ndarray) -> tuple[int, np.ndarray, float]:
        """Page number, centre and covering radius of the subtree over ``rows``."""
        centre = self.points[rows].mean(axis=0)
        if len(rows) <= self.page:
            away = _distances(self.points[rows], centre)
            self.pages.append((True, away, None, self.ids[rows], self.points[rows], self.vectors[rows]))
            return len(self.pages) - 1, centre, float(away.max())
        parts = self._split(rows)
        built = [self._build(p) for p in parts]
        centres = np.array([c for _, c, _ in built])
        away = _distances(centres, centre)
        radii = np.array([r for _, _, r in built])
        self.pages.append((False, away, radii, [p for p, _, _ in built], centres, None))
        return len(self.pages) - 1, centre, float(_distances(self.points[rows], centre).max())

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Cut by nearest of a few far-apart pivots; equal points are dealt in pages of their own."""
        fan = min(self.page, max(2, math.ceil(len(rows) / self.page)), 16)
        points = self.points[rows]
        pivots = [0]
        nearest = _distances(points, points[0])
        owner = np.zeros(len(rows), int)
        for k in range(1, fan):
            far = int(nearest.argmax())
            if nearest[far] == 0:
                break
            d = _distances(points, points[far])
            owner[d < nearest] = k
            nearest = np.minimum(nearest, d)
            pivots.append(far)
        if len(pivots) == 1:
            return np.array_split(rows, math.ceil(len(rows) / max(self.page, math.ceil(len(rows) / self.page))))
        return [rows[owner == k] for k in range(len(pivots)) if (owner == k).any()]

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query but for rows of its own id, and how many vectors it was compared with.

        Pages come by the smallest possible distance that any query still has to them, each once for all queries that may need it; entries are
        cut by stored bounds. Scores are those from ``known`` on, if it is a number. Returns scores and ids of (query, place), best first; places that
        stay empty have the score ``NONE``. Lower scores may be among them where products are too large for a double.
        """
        points = np.column_stack([queries.astype(float), np.zeros(len(queries))])
        q2 = (points**2).sum(axis=1)
        # Up to 2**53 all partial sums of a product are whole numbers that a double holds.
        exact = math.sqrt(self.norm2 * q2.max(initial=0.0)) < 2.0**53
        slack = 1e-6 * (1 + np.sqrt(self.norm2 + q2))
        reach = lambda score, at: np.sqrt(np.maximum(q2[at] + self.norm2 - 2 * score, 0.0)) + slack[at]
        limit = np.where(np.isnan(known), np.inf, reach(np.nan_to_num(known), slice(None)))
        least = np.where(np.isnan(known), NONE, np.nan_to_num(known)).astype(np.int64) if exact else np.full(len(queries), NONE)
        scores, ids = np.full((len(queries), k), NONE), np.full((len(queries), k), np.iinfo(np.int64).max)
        compared = np.zeros(len(queries), np.int64)
        away = _distances(points, self.centre)
        low = np.maximum(away - self.radius, 0.0)
        heap, count = [(low.min(initial=np.inf), 0, self.root, np.arange(len(queries)), away, low)], 0
        while heap:
            _, _, number, asked, d_page, low = heapq.heappop(heap)
            leaf, away, radii, below, centres, vectors = self.pages[number]
            near = np.abs(d_page[:, None] - away) - (0 if leaf else radii) <= limit[asked, None]
            near &= (low <= limit[asked])[:, None]
            some, entries = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(some):
                continue
            asked, near = asked[some], near[np.ix_(some, entries)]
            if not leaf:
                d = np.stack([_distances(points[asked], centres[e]) for e in entries], axis=1)
                low = np.maximum(d - radii[entries], 0.0)
                near &= low <= limit[asked, None]
                for j in np.flatnonzero(near.any(axis=0)).tolist():
                    go, count = near[:, j], count + 1
                    heapq.heappush(heap, (low[go, j].min(), count, below[entries[j]], asked[go], d[go, j], low[go, j]))
                continue
            met = (points[asked, :-1] @ centres[entries, :-1].T).astype(np.int64) if exact else queries[asked] @ vectors[entries].T
            compared[asked] += len(entries)
            better = near & (met >= least[asked, None]) & (own_ids[asked, None] != below[entries])
            more = np.flatnonzero(better.any(axis=1))
            at = asked[more]
            all_scores = np.hstack([scores[at], np.where(better[more], met[more], NONE)])
            all_ids = np.hstack([ids[at], np.broadcast_to(below[entries], (len(at), len(entries)))])
            first = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[at], ids[at] = np.take_along_axis(all_scores, first, axis=1), np.take_along_axis(all_ids, first, axis=1)
            at = at[scores[at, -1] > NONE]
            least[at], limit[at] = scores[at, -1], np.minimum(limit[at], reach(scores[at, -1], at))
        return scores, ids, compared


def _lifted(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """One coordinate more, so that all stored vectors have the same norm."""
    return np.column_stack([vectors, np.sqrt(np.maximum(norm2 - (vectors**2).sum(axis=1), 0.0))])


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Places of up to ``n`` pivots, each the point farthest from those before it."""
    chosen, nearest = [0], _distances(points, points[0])
    while len(chosen) < n:
        far = int(nearest.argmax())
        if nearest[far] == 0:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, _distances(points, points[far]))
    return np.array(chosen)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _by_dim(batch: pa.RecordBatch):
    """The parts of a batch with vectors of one length."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        yield int(d), batch.take(pa.array(np.flatnonzero(dims == d))) if len(np.unique(dims)) > 1 else batch


def _assign(pivots: dict[int, np.ndarray], norm2: float, stored: bool):
    """Nearest pivot of every vector and its distance; queries are lifted by zero, stored vectors to the common norm."""

    def run(batches):
        for batch in batches:
            for d, part in _by_dim(batch):
                v = _matrix(part.column("v")).astype(float)
                cell, far = np.zeros(len(v), np.int32), np.zeros(len(v))
                if d in pivots:
                    at = _lifted(v, norm2) if stored else np.column_stack([v, np.zeros(len(v))])
                    for k in range(0, len(at), 1024):
                        gap = ((at[k : k + 1024, None, :] - pivots[d][None]) ** 2).sum(axis=2) if len(pivots[d]) <= 16 else np.stack([((at[k : k + 1024] - c) ** 2).sum(axis=1) for c in pivots[d]], axis=1)
                        cell[k : k + 1024], far[k : k + 1024] = gap.argmin(axis=1), np.sqrt(gap.min(axis=1))
                yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(cell), part.column("vec_id"), part.column("v"), pa.array(far)], names=["dim", "cell", "vec_id", "v", "far"])

    return run


def _route(cells: dict[int, list[tuple[int, float]]], pivots: dict[int, np.ndarray], norm2: float):
    """The cells beyond its own whose ball may hold a better or equal answer than a query's limit."""

    def run(batches):
        for batch in batches:
            for d, part in _by_dim(batch):
                v = _matrix(part.column("v")).astype(float)
                q2 = (v**2).sum(axis=1)
                limit = part.column("limit").to_numpy(zero_copy_only=False)
                own = part.column("cell").to_numpy()
                slack = 1e-6 * (1 + np.sqrt(norm2 + q2))
                reach = np.where(np.isnan(limit), np.inf, np.sqrt(np.maximum(q2 + norm2 - 2 * np.nan_to_num(limit), 0.0))) + slack
                at = np.column_stack([v, np.zeros(len(v))])
                for cell, radius in cells.get(d, ()):
                    low = (np.sqrt(((at - pivots[d][cell]) ** 2).sum(axis=1)) if d in pivots else np.zeros(len(v))) - radius
                    go = np.flatnonzero((low <= reach) & (own != cell))
                    if len(go):
                        taken = part.take(pa.array(go))
                        columns = [taken.column("dim"), pa.array(np.full(len(go), cell, np.int32)), taken.column("vec_id"), taken.column("v"), taken.column("limit")]
                        yield pa.RecordBatch.from_arrays(columns, names=["dim", "cell", "vec_id", "v", "limit"])

    return run


def _pack(key, rows):
    """One block: its ids, integer vectors and, of queries, limits, as bytes."""
    ids, vectors = rows["vec_id"].to_numpy(), _matrix(rows["v"])
    order = np.argsort(ids, kind="stable")
    out = {"dim": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([key[2].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "vectors": [np.ascontiguousarray(vectors[order]).tobytes()]}
    if "limit" in rows.column_names:
        out["limits"] = [rows["limit"].to_numpy()[order].tobytes()]
    return pa.table(out)


def _search(k: int, page: int, norm2: float):
    """Best-first search of each packed query in the block it meets; one tree is kept while its block comes again."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("n_compared", pa.int64())])

    def run(batches):
        kept = (None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, queries = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                name = row["dim"], row["cell"], row["block"]
                if kept[0] != name:
                    kept = name, MTree(ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["dim"]), norm2, page)
                vectors = np.frombuffer(row["q_vectors"], np.int64).reshape(len(queries), row["dim"])
                scores, found, compared = kept[1].search(vectors, queries, k, np.frombuffer(row["q_limits"], np.float64))
                own, _ = full = np.nonzero(scores > NONE)
                # A row without vector carries the count of compared vectors.
                none = pa.nulls(len(queries), pa.int64())
                answers = [queries[own], found[full], scores[full], np.zeros(len(own), np.int64)]
                out = [pa.concat_arrays([pa.array(x), y if isinstance(y, pa.Array) else pa.array(y)]) for x, y in zip(answers, [queries, none, none, compared])]
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def exact_top_k(
    vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, block_rows: int = 4_000, query_rows: int = 500, page: int = 64, max_cells: int = 256, sample_rows: int = 4_096, counts: bool = False, meetings: list | None = None
) -> DataFrame:
    """The ``k`` highest integer inner products of each query over all other rows, ties to the smaller id.

    Components become floor(scale * x). The index has three levels: cells around up to ``max_cells`` far-apart pivots (chosen
    from the ``sample_rows`` rows with the smallest hashes; every row is indexed, at its nearest pivot), blocks of about ``block_rows`` within
    a cell, and in each block an M-tree of pages with covering radii and parent distances. A query is searched in its own cell
    first; its k-th score is the limit with which it goes only to those other cells whose covering ball, by the triangle inequality, may hold
    an equal or better one, and there into the trees, best-first. Each query keeps the best ``k`` of its blocks'
    answers. A task holds one block and one pack of about ``query_rows`` queries; shared data are the pivots and radii, ``max_cells`` rows.
    ``queries`` has the same columns as ``vectors``; by default rows whose id is divisible by 100.

    Nulls and edge cases: null vectors and ids, empty vectors and vectors with a null or non-finite component take no part; vectors meet only
    vectors of their own length; a query with fewer than ``k`` candidates returns all; repeated ids are candidates each, but
    never of a query with their id; an empty table gives an empty result; only the two named columns are read. If the square of a scaled vector's length
    reaches 2**62, scores might not fit a long: a ValueError.

    ``meetings`` collects how many (block, pack) pairs each of the two searches has.

    Returns ``query_id, rank, vec_id, score``; with ``counts`` also ``n_compared``, the stored vectors a query's score was computed for.
    """

    def clean(df):
        v = F.col(vector_col)
        ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
        scaled = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
        rows = df.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"), v.alias("raw"))
        norm = F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.pow(F.lit(float(scale)) * x.cast("double"), F.lit(2.0)))
        return rows.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"))

    base = clean(vectors)
    asked = base.where(F.col("vec_id") % 100 == 0) if queries is None else clean(queries)
    longest = F.max(F.when(F.col("norm") < 2.0**62, F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)))
    n, top, norm2 = base.agg(F.count("*"), F.max("norm"), longest).first()
    (top_query,) = (top,) if queries is None else asked.agg(F.max("norm")).first()
    if max(top or 0.0, top_query or 0.0) >= 2.0**62:
        raise ValueError("scores of these vectors may not fit a long")
    norm2 = float(norm2 or 0)
    pivots: dict[int, np.ndarray] = {}
    n_cells = min(max_cells, -(-n // block_rows))
    if n_cells > 1:
        drawn = base.select("dim", "v", F.xxhash64("vec_id", F.lit(3)).alias("h")).orderBy("h", "dim").limit(sample_rows).collect()
        for d in sorted({r.dim for r in drawn}):
            points = _lifted(np.array([r.v for r in drawn if r.dim == d], float), norm2)
            pivots[d] = points[far_apart(points, max(1, round(n_cells * len(points) / len(drawn))))]
    kinds = "dim int, cell int, vec_id long, v array<long>, far double"
    stored = base.select("dim", "vec_id", "v").mapInArrow(_assign(pivots, norm2, True), kinds)
    stored = checkpointed(stored) if n_cells > 1 else stored
    sizes = stored.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    cells: dict[int, list[tuple[int, float]]] = {}
    for r in sizes:
        cells.setdefault(r.dim, []).append((r.cell, r.radius))
    blocks = F.coalesce(*[F.when((F.col("dim") == r.dim) & (F.col("cell") == r.cell), F.lit(-(-r.n // block_rows))) for r in sizes if r.n > block_rows], F.lit(1))
    packed = "dim int, cell int, block int, ids binary, vectors binary"
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), blocks).cast("int")
    trees = checkpointed(stored.select("dim", "cell", block.alias("block"), "vec_id", "v").groupBy("dim", "cell", "block").applyInArrow(_pack, packed))
    n_blocks = {(r.dim, r.cell): -(-r.n // block_rows) for r in sizes}

    def meet(rows):
        """Search ``rows`` (dim, cell, vec_id, v, limit), checkpointed, in all blocks of their cells.

        A cell has a pack for each ``query_rows`` of its own queries, so a block is sent only to as many packs as its cell needs.
        """
        of_cell = {(r.dim, r.cell): -(-r.n // query_rows) for r in rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
        # A meeting is little data and much work, so meetings are dealt out evenly whatever their size in bytes.
        n_meetings = sum(n * n_blocks.get(name, 0) for name, n in of_cell.items())
        tasks = min(20_000, max(1, n_meetings))
        if meetings is not None:
            meetings.append(n_meetings)
        parts = F.coalesce(*[F.when((F.col("dim") == d) & (F.col("cell") == c), F.lit(n)) for (d, c), n in of_cell.items() if n > 1], F.lit(1))
        pack = F.pmod(F.xxhash64("vec_id", F.lit(5)), parts).cast("int")
        packs = rows.select("dim", "cell", pack.alias("block"), "vec_id", "v", "limit").groupBy("dim", "cell", "block").applyInArrow(_pack, packed + ", limits binary")
        packs = packs.select("dim", "cell", F.col("block").alias("pack"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("limits").alias("q_limits"))
        met = trees.join(packs.hint("merge"), ["dim", "cell"]).repartition(tasks, "dim", "cell", "block", "pack")
        return met.select("dim", "cell", "block", "ids", "vectors", "q_ids", "q_vectors", "q_limits").mapInArrow(_search(k, page, norm2), "query_id long, vec_id long, score long, n_compared long")

    def best(rows):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.where("vec_id IS NOT NULL").withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)

    home = asked.select("dim", "vec_id", "v").distinct().mapInArrow(_assign(pivots, norm2, False), kinds)
    home = checkpointed(home.drop("far").withColumn("limit", F.lit(float("nan"))))
    found = checkpointed(meet(home))
    if n_cells > 1:
        limit = best(found).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("limit"))
        again = home.drop("limit").join(limit, "vec_id", "left").select("dim", "cell", "vec_id", "v", F.coalesce("limit", F.lit(float("nan"))).alias("limit"))
        routed = checkpointed(again.mapInArrow(_route(cells, pivots, norm2), "dim int, cell int, vec_id long, v array<long>, limit double"))
        found = found.unionByName(meet(routed))
        found = checkpointed(found) if counts else found
    out = best(found).select("query_id", "rank", "vec_id", "score")
    if counts:
        work = found.groupBy(F.col("query_id").alias("_q")).agg(F.sum("n_compared").alias("n_compared"))
        out = out.join(work, F.col("query_id") == F.col("_q")).drop("_q")
    return out
