"""Quantiles and distinct counts from sketches that are stored per part and merged later.

A sketch is a few kilobytes whatever it has seen. Each part of a table (a day, a file, a
source) keeps its own, new parts only add rows, and any set of parts is merged without
reading the data again. The error is a parameter; exact forms are in ``quantiles`` and
``profile``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Rank error of a KLL sketch is about 2.296 / k^0.9021 at 99 % confidence, and the
# relative standard error of merged HyperLogLog sketches 1.04 / sqrt(2^lg); both as published.
KLL_SCALE, KLL_POWER, KLL_SIZES = 2.296, 0.9021, (8, 65_535)
HLL_SCALE, HLL_SIZES = 1.04, (4, 21)
DEVIATIONS = 3


def kll_size(rank_error: float) -> int:
    """``k`` of a sketch whose quantiles lie within ``rank_error`` (a share of all rows) of their rank."""
    size = math.ceil((KLL_SCALE / rank_error) ** (1 / KLL_POWER))
    if not KLL_SIZES[0] <= size <= KLL_SIZES[1]:
        raise ValueError(f"no sketch has a rank error of {rank_error}")
    return size


def hll_size(error: float) -> int:
    """Logarithm of the buckets of a sketch with a relative ``error`` of three standard deviations."""
    size = max(HLL_SIZES[0], math.ceil(2 * math.log2(DEVIATIONS * HLL_SCALE / error)))
    if size > HLL_SIZES[1]:
        raise ValueError(f"no sketch has a relative error of {error}")
    return size


def quantile_sketches(df: DataFrame, column: str, part: list[str], rank_error: float = 0.005) -> DataFrame:
    """(part..., sketch): one quantile sketch per part; null values are left out."""
    return df.groupBy(*part).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), kll_size(rank_error)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """Rows (prob, value) of all parts together; none where no part saw a value."""
    merged = sketches.agg(F.kll_merge_agg_double("sketch").alias("_all"))
    cells = [
        F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("_all", F.lit(float(p))).alias("value"))
        for p in probs
    ]
    return merged.where(F.kll_sketch_get_n_double("_all") > 0).select(F.inline(F.array(*cells)))


def distinct_sketches(df: DataFrame, columns: list[str], part: list[str], error: float = 0.02) -> DataFrame:
    """(part..., one sketch per column); null values are left out."""
    size = hll_size(error)
    return df.groupBy(*part).agg(*[F.hll_sketch_agg(F.col(c), size).alias(c) for c in columns])


def merged_distinct(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the estimated number of distinct values of each column over all parts."""

    def estimate(column: str) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(column)), F.lit(0)).alias(column)

    return sketches.agg(*[estimate(c) for c in columns])
