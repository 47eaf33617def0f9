"""Vector functions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, distance: str) -> Column:
    """cosine and dot: larger is nearer; euclid: smaller is. Cosine with a zero vector is null."""
    if distance == "dot":
        return dot(a, b)
    if distance == "euclid":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    if distance == "cosine":
        return F.try_divide(dot(a, b), norm(a) * norm(b))
    raise ValueError("distance must be cosine, dot or euclid")


def fault(vector: Column, dimension: int, distance: str = "cosine", normalized: bool = True) -> Column:
    """What is wrong with a vector, null if nothing: dimension, finite, zero or norm (off 1 by more than 1e-4)."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        F.when(vector.isNull() | (F.size(vector) != dimension), "dimension")
        .when(odd, "finite")
        .when((norm(vector) == 0) & F.lit(distance == "cosine"), "zero")
        .when((F.abs(norm(vector) - 1) > 1e-4) & F.lit(normalized), "norm")
    )


def normalized(vector: Column) -> Column:
    """The vector over its length; null for one of length zero or without a finite length."""
    length = norm(vector)
    return F.when((length > 0) & (length < F.lit(float("inf"))) & ~F.isnan(length), F.transform(vector, lambda x: x / length))
