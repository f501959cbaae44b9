"""Vector functions on array<float> columns; all sums are double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero; held within [-1, 1]."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(c > 1, 1.0).when(c < -1, -1.0).otherwise(c)


def unit(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def literal(values: list[float]) -> Column:
    return F.lit([float(v) for v in values])
