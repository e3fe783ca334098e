"""Class labels from bin edges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quantile_class(value: Column, edges: Column) -> Column:
    """0 up to the first edge, then one class per edge; null above the last."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.when(value <= F.element_at(edges, -1), below)


def edge_class(value: Column, edges: Column) -> Column:
    """Index of the last edge that is not above the value, at least 0."""
    return F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e <= value)) - 1)
