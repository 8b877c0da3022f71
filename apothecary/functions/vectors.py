"""Dot products and unit vectors over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda n, x: n + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """``v`` over its length; a zero vector is divided by 1e-9."""
    n = norm(v)
    return F.transform(v.cast("array<double>"), lambda x: x / F.when(n == 0, F.lit(1e-9)).otherwise(n))
