"""Prefix sums over ranges of the rows, for orders that no column divides evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from encore.sources.workspace import cut


def range_prefix_sum(
    df: DataFrame, value: str, order: list[str], out: str, keys: list[str] | None = None, parts: int | None = None
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the same keys, in rising order; 0 for the first.

    The rows are cut into ranges of (keys, order) whose borders Spark samples, so a key with
    a large part of all rows, or a table without keys, lies in many tasks whatever its values
    look like. A range begins inside at most one key; what earlier ranges hold of that key is
    carried into it, one row per range. ``order`` should tell the rows of a key apart: rows
    that it does not tell apart lie in one range, in any order. Null keys are one key, null
    values count 0. ``parts`` fixes the number of ranges.
    """
    keys = keys or []
    by = [*keys, *order]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    rows = cut(ranged.withColumn("_range", F.spark_partition_id()))
    earlier_ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("_range", *keys).agg(F.sum(value).alias("_sum"))
        .withColumn("_carried", F.sum("_sum").over(earlier_ranges))
        .where("_carried <> 0")
        .select(F.col("_range").alias("_into"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_carried")
    )
    same: Column = F.col("_range") == F.col("_into")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # At most one row per range: as many as the shuffle has partitions.
    placed = summed.join(F.broadcast(carried), same, "left")
    return placed.withColumn(out, F.coalesce("_carried", F.lit(0)) + F.col("_inside")).drop(
        "_range", "_into", "_carried", "_inside", *[f"_key{i}" for i in range(len(keys))]
    )


def range_rank(df: DataFrame, order: list[str], out: str = "rank", keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """1-based row number in ``order`` inside ``keys``, range by range."""
    ranked = range_prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", order, out, keys, parts)
    return ranked.withColumn(out, F.col(out) + 1).drop("_one")
