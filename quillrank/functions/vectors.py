"""Vector arithmetic on ``array<float>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length; null for a missing, empty or all-zero vector."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, length)


def normalize(v: Column) -> Column:
    """Unit vector, or null where there is nothing to normalize."""
    length = norm(v)
    return F.when(length.isNotNull(), F.transform(v, lambda x: (x.cast("double") / length).cast("float")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a side has no vector or the sizes differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / (norm(a) * norm(b)))


def has_vector(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0)
