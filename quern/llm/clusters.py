"""K-means over ball trees: whole balls go to one centroid where the triangle inequality allows, the rest is decided at the leaves."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed

_BLOCK = pa.schema([(c, pa.binary()) for c in ("ids", "nulls", "points", "nodes", "sums", "radii")])
_NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("parent", "<i4")])
#: Components beyond this could give distances that do not fit a long.
MOST = 1 << 27


def build_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A metric tree over integer points: order of the points, nodes by level, and each node's sum and radius.

    A node covers a run of the order. It is split at the median of the projection on the line between two far members, down to
    runs of ``leaf`` points or of equal points; its ball lies around its mean.
    """
    order = np.arange(len(points))
    nodes, sums, radii, level = [], [], [], [(0, len(points), -1)]
    while level:
        below = []
        for start, end, parent in level:
            own = points[order[start:end]]
            total = own.sum(axis=0)
            apart = own - total / (end - start)
            distance = np.sqrt((apart * apart).sum(axis=1))
            nodes.append((start, end, parent)), sums.append(total), radii.append(distance.max())
            if end - start > leaf and radii[-1] > 0:
                one = own[distance.argmax()]
                apart = (own - one).astype(np.float64)
                other = own[(apart * apart).sum(axis=1).argmax()]
                side = apart @ (other - one).astype(np.float64)
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(side, half)]
                below += [(start, start + half, len(nodes) - 1), (start + half, end, len(nodes) - 1)]
        level = below
    return order, np.array(nodes, _NODE), np.array(sums, np.int64), np.array(radii, np.float64) * (1 + 1e-9)


def _blocks(rows: int, leaf: int):
    """Trees of up to ``rows`` vectors of one partition."""

    def packed(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        order, nodes, sums, radii = build_tree(points, leaf)
        nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        values = (ids[order].astype(np.int64), nulls[order], points[order].astype(np.int32), nodes, sums, radii)
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], schema=_BLOCK)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= rows:
                table = pa.Table.from_batches(held)
                yield from cut(table.slice(0, rows))
                held, n = table.slice(rows).to_batches(), n - rows
        if n:
            yield from cut(pa.Table.from_batches(held))

    def cut(table: pa.Table):
        table = table.combine_chunks()
        vectors = table.column("vector").combine_chunks()
        points = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).astype(np.int64)
        yield packed(table.column("id").combine_chunks(), points)

    return run


def exact_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centroids as exact integers; by matrix product where doubles hold every term."""
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * points.shape[1] * int(most) ** 2 < 1 << 53:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Assigned:
    """One block's tree against the centroids: nodes that go whole, rows of leaves that were decided one by one."""

    def __init__(self, row: dict, centroids: np.ndarray):
        self.nodes, self.ids = np.frombuffer(row["nodes"], _NODE), np.frombuffer(row["ids"], np.int64)
        self.nulls, dims = np.frombuffer(row["nulls"], bool), centroids.shape[1]
        self.points = np.frombuffer(row["points"], np.int32).reshape(-1, dims).astype(np.int64)
        self.sums, radii = np.frombuffer(row["sums"], np.int64).reshape(-1, dims), np.frombuffer(row["radii"], np.float64)
        nodes, size = self.nodes, (self.nodes["end"] - self.nodes["start"])[:, None]
        apart = (self.sums / size)[:, None, :] - centroids[None, :, :]
        distance = np.sqrt((apart * apart).sum(axis=2))
        near = distance.argmin(axis=1)
        ranked = np.sort(distance, axis=1)
        beaten = ranked[:, 1] - radii > (ranked[:, 0] + radii) * (1 + 1e-9) + 1e-6 if len(centroids) > 1 else np.ones(len(nodes), bool)
        reached, inner = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
        inner[nodes["parent"][nodes["parent"] >= 0]] = True
        reached[:1] = True
        for k in range(1, len(nodes)):  # parents stand before their children
            up = nodes["parent"][k]
            reached[k] = reached[up] and not beaten[up]
        self.whole = np.flatnonzero(reached & beaten)
        self.whole_cluster = near[self.whole]
        leaves = np.flatnonzero(reached & ~beaten & ~inner)
        self.rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(nodes["start"][k], nodes["end"][k]) for k in leaves)])
        self.row_distances = exact_distances(self.points[self.rows], centroids)
        self.row_cluster = self.row_distances.argmin(axis=1)


def _sums(centroids: np.ndarray):
    """Counts and componentwise sums of each cluster, one row a partition and cluster."""
    k, dims = centroids.shape

    def run(batches):
        n, total, compared = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                got = Assigned(row, centroids)
                size = got.nodes["end"] - got.nodes["start"]
                np.add.at(n, got.whole_cluster, size[got.whole])
                np.add.at(total, got.whole_cluster, got.sums[got.whole])
                np.add.at(n, got.row_cluster, 1)
                np.add.at(compared, got.row_cluster, 1)
                np.add.at(total, got.row_cluster, got.points[got.rows])
        own = np.flatnonzero(n)
        columns = [pa.array(own, pa.int32()), pa.array(n[own]), pa.array(compared[own]), pa.array(list(total[own]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "compared", "total"])

    return run


def _rows(centroids: np.ndarray):
    """Cluster and exact squared distance of every vector."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = Assigned(row, centroids)
                cluster = np.zeros(len(got.ids), np.int32)
                for node, c in zip(got.whole, got.whole_cluster):
                    cluster[got.nodes["start"][node] : got.nodes["end"][node]] = c
                cluster[got.rows] = got.row_cluster
                distance = ((got.points - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(got.ids, mask=got.nulls), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as long; a component beyond ``MOST`` is an error, as distances might not fit a long."""
    over = F.concat(F.lit("component out of range: "), F.lit(MOST))

    def one(x: Column) -> Column:
        return F.when(F.abs(x * scale) < MOST, F.floor(x * scale)).otherwise(F.raise_error(over).cast("long"))

    return F.transform(vector.cast("array<double>"), one)


def ball_tree_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3", block_rows: int = 4096, leaf: int = 32, stats: list | None = None) -> DataFrame:
    """K-means with integer components and exact floor means, its rounds filtered by partition-local ball trees.

    1. Each partition packs its vectors into blocks of ``block_rows`` with a metric tree each, whose nodes store radius, count and
    integer sum (checkpointed once; no vector is shuffled). 2. A round meets every tree with the centroids: a ball for
    which the second nearest centroid stays farther than the nearest, by the triangle inequality, adds its count and sum as
    a whole; else its children are asked, and the rows of an undecided leaf are compared exactly. What comes back is one
    row a cluster. 3. The last assignment gives each vector's exact distance.

    Takes vectors with exactly ``dims`` components, none null or non-finite. The starts are the ``clusters`` vectors with the smallest
    SHA-256 of ``seed:id``, equal digests by their components, null ids last; ties of distance go to the smaller number; an
    empty cluster keeps its centroid. The driver holds ``clusters`` x ``dims`` integers.

    Nulls and edge cases: a vector with a null id is clustered like the others; repeated rows count each; with fewer vectors than
    ``clusters`` there are as many clusters as vectors; an empty table gives an empty result; components over ``MOST`` are an error, and so
    are sums that do not fit a long; only the two named columns are read. ``stats`` collects (vectors, vectors compared one by one) of every round.

    Returns ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.
    """
    vector = F.col(vector_col)
    fine = vector.isNotNull() & (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), vector.alias("raw")).select("id", quantised(F.col("raw"), scale).alias("vector"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = kept.select(digest.alias("digest"), "vector").orderBy(F.col("digest").asc_nulls_last(), "vector").limit(clusters).collect()
    schema = "vec_id long, cluster int, distance long"
    if not starts:
        rows = vectors.sparkSession.createDataFrame([], schema)
        return rows.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    centroids = np.array([r["vector"] for r in starts], np.int64)
    blocks = checkpointed(kept.mapInArrow(_blocks(block_rows, leaf), ", ".join(f"{c} binary" for c in _BLOCK.names)))
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(centroids), "cluster int, n long, compared long, total array<long>")
        found = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("compared").alias("compared"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total")).collect()
        for row in found:
            centroids[row["cluster"]] = [x // row["n"] for x in row["total"]]
        if stats is not None:
            stats.append((sum(r["n"] for r in found), sum(r["compared"] for r in found)))
    assigned = checkpointed(blocks.mapInArrow(_rows(centroids), schema))
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    of_cluster = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return assigned.withColumns({
        "cluster_inertia": of_cluster([inertia.get(k, 0) for k in range(len(centroids))], "long"),
        "inertia": F.lit(sum(inertia.values())).cast("long"),
        "centroid_sha256": of_cluster(names, "string"),
    })
