"""Vector helpers over array columns; sums run from left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def axpy(scale: Column | float, a: Column, b: Column) -> Column:
    """scale * a + b."""
    k = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.zip_with(_d(a), _d(b), lambda x, y: k * x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: x - y)


def scale(k: Column | float, a: Column) -> Column:
    c = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(_d(a), lambda x: c * x)


def negate(a: Column) -> Column:
    return F.transform(_d(a), lambda x: -x)
