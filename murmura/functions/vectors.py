"""Vectors as column expressions, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def usable(v: Column, dim: int) -> Column:
    """Full length, no null or NaN, not all zero."""
    return (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def l2_normalized(v: Column) -> Column:
    """A vector over its norm; null for a zero vector.

    The norm is bound as the one element of an outer list: named inside the inner function, it would be summed anew for each value.
    """
    x = doubles(v)
    return F.transform(F.array(norm(x)), lambda n: F.when(n > 0, F.transform(x, lambda y: y / n)))[0]
