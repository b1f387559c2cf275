"""Vector functions over ARRAY<DOUBLE> columns, all as built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length; null if either is null."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with the dot product over the shorter length and whole norms; 0 if a norm is 0."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(both, F.lit(0.0)))


def cosine_same_length(a: Column, b: Column) -> Column:
    """Cosine that is 0 for empty vectors and vectors of different lengths."""
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(cosine(a, b))


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / F.nullif(n, F.lit(0.0))))


def _times(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x * by)


def combine(weighted: list[tuple[Column, float]]) -> Column:
    """Weighted mean of unit vectors, shorter ones padded with zeros; null ones take no part
    and their weight does not count. Null if all are null. The result is not normalised again."""
    total, weights = F.array().cast("array<double>"), F.lit(0.0)
    for v, w in weighted:
        part = F.coalesce(_times(unit(v), float(w)), F.array().cast("array<double>"))
        total = F.zip_with(total, part, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
        weights = weights + F.when(v.isNull(), F.lit(0.0)).otherwise(F.lit(float(w)))
    return F.when(weights > 0, F.transform(total, lambda x: x / weights))


def normalised_weights(weights: list[float]) -> list[float]:
    """Weights as given if they sum to 1 within 0.01, else divided by their sum."""
    total = sum(weights)
    return list(weights) if abs(total - 1) <= 0.01 or total == 0 else [w / total for w in weights]
