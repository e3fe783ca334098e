"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null when a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def mean_vector(vectors: Column | str) -> Column:
    """Mean of an array of equally long vectors."""
    v = F.col(vectors) if isinstance(vectors, str) else vectors
    zero = F.transform(F.element_at(v, 1), lambda x: F.lit(0.0))
    total = F.aggregate(v, zero, lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    return F.transform(total, lambda x: x / F.size(v))
