"""Dense and sparse vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is null or has norm zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))
