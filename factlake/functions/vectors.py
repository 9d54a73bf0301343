"""Cosine distance as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances closer than this are ties and fall back to the id order.
DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where a vector is null or has no length."""
    return F.round(1 - F.try_divide(dot(a, b), norm(a) * norm(b)), DIGITS)
