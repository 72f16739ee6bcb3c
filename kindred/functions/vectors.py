"""Vectors as arrays; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column, floor: float = 1e-10) -> Column:
    """v by its norm, which counts as `floor` at least."""
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / n)


def unit_or_empty(v: Column, least: float = 1e-8) -> Column:
    """v by its norm, or an empty array where the norm is at most `least`."""
    return F.when(norm(v) <= least, F.expr("cast(array() as array<double>)")).otherwise(unit(v, 0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
