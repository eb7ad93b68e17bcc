"""Vector functions over arrays of floats; all arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; NaN if either vector is null or all zeros, an error if their lengths differ."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    ragged = F.size(a) != F.size(b)
    value = F.when(ragged, F.raise_error(F.lit("vectors of different lengths")).cast("double")).when(size > 0, 1 - dot(a, b) / F.nullif(size, F.lit(0.0)))
    return F.coalesce(value, F.lit(float("nan")))


def to_text(vector: Column) -> Column:
    return F.to_json(vector)


def from_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def is_zero(vector: Column) -> Column:
    """First and last components are zero, which is taken for a failed embedding."""
    return (F.try_element_at(vector, F.lit(1)) == 0) & (F.try_element_at(vector, F.lit(-1)) == 0)
