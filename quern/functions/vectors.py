"""Column expressions over vectors and sets; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if either vector is zero, null if either is null. Norms may be given if they are at hand."""
    x, y = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(dot(a, b) / (x * y))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the size of the smaller set; 0 if either is empty or null."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(F.coalesce(least, F.lit(0)) <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)
