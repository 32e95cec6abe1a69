"""Vector expressions over array columns, summed in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row; within the function of a transform it would be computed for each component."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return once(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def exp_map(v: Column, c: float = 1.0, most: float = 1.0) -> Column:
    """Exponential map at the origin of the projected hypersphere of curvature ``c``, norms clipped to ``most``."""
    def scale(n):
        r = F.least(n, F.lit(most))
        return F.when(n > 0, r / n * F.tan(F.sqrt(F.lit(c)) * r) / (F.sqrt(F.lit(c)) * r)).otherwise(F.lit(1.0))

    return once(norm(v), lambda n: once(scale(n), lambda s: F.transform(v, lambda x: x * s)))


def geodesic(x: Column, y: Column, c: float = 1.0, eps: float = 1e-7) -> Column:
    """Distance on the projected hypersphere."""
    gap = total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))
    cos = 1 - 2 * c * gap / ((1 + c * dot(x, x)) * (1 + c * dot(y, y)))
    return F.acos(F.least(F.greatest(cos, F.lit(-1 + eps)), F.lit(1 - eps))) / F.sqrt(F.lit(c))


def mean_vector(v: str, dim: int) -> Column:
    """Element-wise average as an aggregate: one partial sum for each component, combined map-side."""
    return F.array(*[F.avg(F.get(F.col(v), F.lit(i)).cast("double")) for i in range(dim)])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
