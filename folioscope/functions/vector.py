"""Vector arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero, null where one is null; vectors of different lengths are an error."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    unlike = F.raise_error("vectors differ in length").cast("double")
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), unlike).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit_interval(c: Column) -> Column:
    """A cosine on 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c + 1) / 2))


def min_max(c: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 0.0).otherwise((c - low) / (high - low))
