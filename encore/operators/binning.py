"""Bin edges, bin-count rules and strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from encore.functions.classes import quantile_class
from encore.operators.profile import histogram, shape
from encore.operators.quantiles import quantile_row

STRATA = ["num_tracks", "modified_at", "track_popularity_median"]


def _quantile_array(df: DataFrame, column: str, bins: int) -> DataFrame:
    names = [f"e{i}" for i in range(1, bins + 1)]
    row = quantile_row(df, column, [i / bins for i in range(1, bins + 1)], names)
    return row.select(F.array_distinct(F.array(*names)).alias("edges"))


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Distinct upper quantile edges as rows (idx, edge)."""
    return _quantile_array(df, column, bins).select(F.posexplode("edges").alias("idx", "edge"))


def with_quantile_class(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Add the quantile class of each column as ``<column>_class``."""
    edges = {f"_{c}_edges": _quantile_array(df, c, bins).scalar() for c in columns}
    labels = {
        f"{c}_class": quantile_class(F.col(c).cast("double"), F.col(f"_{c}_edges")) for c in columns
    }
    return df.withColumns(edges).withColumns(labels).drop(*edges)


def stratification_classes(features: DataFrame, bins: int = 10) -> DataFrame:
    """Quantile classes of the three split features."""
    return with_quantile_class(features, STRATA, bins)


def equal_width_edges(df: DataFrame, column: str, bins: int, min_count: int = 3) -> DataFrame:
    """Histogram edges (idx, edge) without the lower edge of each sparse bin."""
    counts = histogram(df, column, bins)
    kept = counts.where(F.col("n") >= min_count).select("bin", F.col("low").alias("edge"))
    top = counts.where(F.col("bin") == bins - 1).select(
        F.lit(bins).cast("long").alias("bin"), F.col("high").alias("edge")
    )
    edges = kept.unionByName(top).agg(F.array_sort(F.collect_list(F.struct("bin", "edge"))).alias("_e"))
    return edges.select(F.posexplode("_e").alias("idx", "e")).select("idx", F.col("e.edge").alias("edge"))


def edges_array(edges: DataFrame) -> DataFrame:
    """Rows (idx, edge) as one row with one array; ``bins`` bounds its length."""
    cells = F.array_sort(F.collect_list(F.struct("idx", "edge")))
    return edges.agg(F.transform(cells, lambda c: c["edge"]).alias("edges"))


def freedman_diaconis(df: DataFrame, column: str) -> DataFrame:
    """``width`` = 2 IQR / cbrt(n), rounded up as ``rule``, and the bins of that width."""
    x = F.col(column).cast("double")
    spread = shape(df, column).select("iqr").scalar()
    one = df.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
    width = 2 * spread / F.cbrt(F.col("n"))
    return one.withColumn("width", width).select(
        "n", "width", F.ceil("width").alias("rule"),
        F.ceil((F.col("high") - F.col("low")) / F.nullif(F.col("width"), F.lit(0.0))).alias("bins"),
    )


def doane(df: DataFrame, column: str) -> DataFrame:
    """Doane's bin count."""
    x = F.col(column).cast("double")
    one = df.agg(F.count(x).alias("n"), F.skewness(x).alias("g1"))
    n = F.col("n").cast("double")
    sigma = F.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
    bins = F.ceil(1 + F.log2(n) + F.log2(1 + F.abs("g1") / sigma))
    return one.select("n", "g1", sigma.alias("sigma"), bins.alias("bins"))


def rare_strata(df: DataFrame, columns: list[str], sets: int = 3) -> DataFrame:
    """Combinations with fewer rows than there are sets."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < sets)


def rows_of_rare_strata(df: DataFrame, columns: list[str], sets: int = 3) -> DataFrame:
    """Rows that lie in a rare combination."""
    return df.join(rare_strata(df, columns, sets), columns, "left_semi")

