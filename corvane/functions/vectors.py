"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    length = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(doubles(v), lambda x: x / length)


def valid(v: Column, dimensions: int) -> Column:
    """Of the right size and finite."""
    return (F.size(v) == dimensions) & F.forall(doubles(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
