"""Numeric columns and small vectors as ARRAY<DOUBLE>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dot(a: Column, b: Column) -> Column:
    """The inner product; norms are not divided out."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def concept_policy(k: Column, corpus: Column) -> tuple[Column, Column]:
    """The number of concepts that a corpus of that many sentences may have, and whether it needs a hierarchy."""
    return F.when(corpus < 100, F.least(k, F.lit(8))).otherwise(F.least(k, F.lit(12))), corpus >= 200


def k_range(n: Column) -> tuple[Column, Column]:
    """The least and the greatest number of clusters worth trying for n units."""
    low = F.greatest(F.lit(4), F.round(F.sqrt(n)).cast("int"))
    return low, F.greatest(low + 1, F.least(F.lit(20), F.floor(n / 4).cast("int")))


def node_size(weight: Column, detail: bool = False) -> Column:
    base, slope, most = (4.0, 6.0, 32.0) if detail else (6.0, 8.4, 48.0)
    return F.least(base + F.log2(weight + 1) * slope, F.lit(most))


def sphere_direction(i: Column, n: Column) -> tuple[Column, Column, Column]:
    """The i-th of n directions spread over the sphere by the golden angle; the first three are the axes' order of the spiral."""
    y = F.when(n > 1, 1 - 2 * i / (n - 1)).otherwise(0.0)
    radius, angle = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y)), math.pi * (3 - math.sqrt(5)) * i
    return F.cos(angle) * radius, y, F.sin(angle) * radius
