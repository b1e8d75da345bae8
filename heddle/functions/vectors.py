"""Vector arithmetic over ARRAY<DOUBLE> columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def norm1(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def divide(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def mean_vector(column: str, size: int) -> Column:
    """Element-wise mean as an aggregate: one avg for each element, so it combines on the map side."""
    return F.array(*(F.avg(F.get(F.col(column), F.lit(i))) for i in range(size)))


def rotate(v: Column, angle_of: Column, half: int) -> Column:
    """Rotary rotation of v (2 * half long): pairs (i, i + half) turn by the angles in angle_of."""
    low = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.get(v, i) * F.cos(F.get(angle_of, i)) - F.get(v, i + half) * F.sin(F.get(angle_of, i)))
    high = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.get(v, i + half) * F.cos(F.get(angle_of, i)) + F.get(v, i) * F.sin(F.get(angle_of, i)))
    return F.concat(low, high)
