"""Pivot cells: which groups of vectors a nearest-neighbour search may leave out, by the triangle inequality.

A cell is the set of vectors nearest to one pivot, with its covering radius. A search visits the cells of a vector in the order of
their lower bounds and stops where the bound is beyond its k-th answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metrics whose values follow from distances that obey the triangle inequality.
PRUNED = ("cosine", "euclidean", "manhattan")


def as_points(v: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as points: for the cosine, unit vectors, whose squared distance is 2 - 2 * cosine.

    A zero vector becomes a point at right angles to all others; to another zero vector its bound is only lower than it need be.
    """
    if metric != "cosine":
        return v
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.hstack([v / np.where(norm > 0, norm, 1.0), norm == 0])


def distances(points: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        return np.stack([np.abs(points - p).sum(axis=1) for p in pivots], axis=1)
    return np.sqrt(np.maximum((points**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * points @ pivots.T, 0.0))


def choose_pivots(points: np.ndarray, n: int, metric: str, rounds: int = 4) -> np.ndarray:
    """``n`` pivots of a sample: each the farthest from those before, then moved to the means of their cells."""
    far, chosen = distances(points, points[:1], metric)[:, 0], [0]
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1:]], metric)[:, 0])
    pivots = points[chosen].copy()
    for _ in range(rounds):
        own = distances(points, pivots, metric).argmin(axis=1)
        for c in np.unique(own):
            pivots[c] = points[own == c].mean(axis=0)
    return pivots


def fit(rows: DataFrame, n: int, metric: str) -> tuple[list, np.ndarray]:
    """The ``8 * n`` rows (``id, tag, v``) with the smallest hashes, and pivots from them; every row is dealt to a cell later."""
    drawn = rows.select("id", "tag", "v", F.xxhash64("id", F.lit(29)).alias("_h")).orderBy("_h").limit(8 * n).collect()
    return drawn, choose_pivots(as_points(np.array([r.v for r in drawn], float), metric), n, metric)


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches, rows: int = 1_024):
    """Small parts of the batches, as a matrix of a part's rows by all cells is held."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def dealt(rows: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Rows (``id, tag, v``) with the ``cell`` of their nearest pivot, the distance ``far`` to it and the length ``size`` of their point."""

    def run(batches):
        for batch in _slices(batches):
            points = as_points(_vectors(batch.column("v")), metric)
            gap = distances(points, pivots, metric)
            size = np.abs(points).sum(axis=1) if metric == "manhattan" else np.linalg.norm(points, axis=1)
            new = [pa.array(gap.argmin(axis=1), pa.int32()), pa.array(gap.min(axis=1)), pa.array(size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "cell", "far", "size"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "tag", "v").mapInArrow(run, f"id long, tag {kinds['tag']}, v array<double>, cell int, far double, size double")


def routed(rows: DataFrame, pivots: np.ndarray, radius: dict[int, float], largest: float, metric: str, first: int, beyond: int) -> DataFrame:
    """Rows (``id, tag, v, worst``) once for each cell at places ``first`` to ``beyond - 1`` of their order that may hold an equal or nearer row.

    ``worst`` is the value of the k-th answer so far, null while there are fewer. Bounds carry a slack for rounding, as values equal to 12
    digits are ties.
    """
    cells = np.array(sorted(radius), np.int64)
    radii = np.array([radius[c] for c in cells.tolist()])
    at = pivots[cells]

    def run(batches):
        for batch in _slices(batches):
            gap = distances(as_points(_vectors(batch.column("v")), metric), at, metric)
            low = np.maximum(gap - radii[None], 0.0)
            worst = batch.column("worst").to_numpy(zero_copy_only=False)
            reach = np.where(np.isnan(worst), np.inf, np.maximum(2 - 2 * worst, 0.0) if metric == "cosine" else worst**2)
            reach = np.sqrt(reach + 1e-10 * largest**2) + 1e-6 * largest
            order = np.lexsort((gap, low))[:, first:beyond]
            row, place = np.nonzero(np.take_along_axis(low, order, axis=1) <= reach[:, None])
            taken = batch.select(["id", "tag", "v"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cells[order[row, place]], pa.int32()), *taken.columns], names=["cell", "id", "tag", "v"])

    return rows.select("id", "tag", "v", "worst").mapInArrow(run, f"cell int, id long, tag {dict(rows.dtypes)['tag']}, v array<double>")
