"""Comparison of two numeric vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def compare_vectors(a: Column, b: Column, atol: float = 1e-5, rtol: float = 1e-5) -> Column:
    """struct<max_abs_diff, cosine, allclose>. A NaN is never close."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    close = F.zip_with(a, b, lambda x, y: F.coalesce(
        ~F.isnan(x) & ~F.isnan(y) & ((x == y) | (F.abs(x - y) <= atol + rtol * F.abs(y))), F.lit(False)))
    return F.struct(
        F.array_max(diffs).alias("max_abs_diff"),
        (dot / (norm + 1e-12)).alias("cosine"),
        F.forall(close, lambda c: c).alias("allclose"))
