"""Numeric functions as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 4) -> Column:
    """Rounded with ties nudged upwards, so that sums in another order give the same digits."""
    return F.round(x + F.lit(1e-9), places)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, has no length, or both differ in dimension."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def interpolated(x: Column, anchors: tuple[tuple[float, float], ...]) -> Column:
    """Piecewise linear through ``(x, y)`` anchors in ascending order, constant outside."""
    pieces = list(zip(anchors[:-1], anchors[1:], strict=True))
    inside = reduce(lambda c, p: c.when(x <= p[1][0], F.lit(p[0][1]) + (x - p[0][0]) * ((p[1][1] - p[0][1]) / (p[1][0] - p[0][0]))), pieces, F.when(x <= anchors[0][0], F.lit(float(anchors[0][1]))))
    return F.when(x.isNotNull(), inside.otherwise(F.lit(float(anchors[-1][1]))))


def weighted(parts: dict[str, float]) -> Column:
    """The weighted mean of columns over those that are present; null if none is."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()))
    weight = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in parts.items()))
    return F.when(weight > 0, total / weight)
