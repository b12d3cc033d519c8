"""Arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def unit(a: Column) -> Column:
    """Scale to length one; a zero vector stays zero."""
    norm = l2_norm(a)
    return F.when(norm == 0, a).otherwise(F.transform(a, lambda v: v / norm))


def argmax(a: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
