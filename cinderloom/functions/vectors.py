"""Vector expressions over arrays, in doubles and in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Each component over the norm, which counts as ``EPSILON`` at least."""
    n = F.greatest(norm(a), F.lit(EPSILON))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def negative_squared_distance(a: Column, b: Column) -> Column:
    return -F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def is_valid(a: Column, dim: int) -> Column:
    return (F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


SCORES = {"cosine": cosine, "inner_product": dot, "l2": negative_squared_distance}
