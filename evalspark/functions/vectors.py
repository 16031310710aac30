"""Arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d)


def l2_normalise(a: Column) -> Column:
    """Scaled to length 1; an all-zero vector stays zero."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)
