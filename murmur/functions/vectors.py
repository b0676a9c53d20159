"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; vectors of unequal length are an error."""
    n = norm(a) * norm(b)
    same = F.when(F.size(a) == F.size(b), n).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return F.when(same == 0, 0.0).otherwise(dot(a, b) / n)
