"""Ranks, running totals and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from encore.operators.ranges import range_prefix_sum, range_rank
from encore.operators.skew import salted_join
from encore.sources.workspace import cut


def hash_order(seed: int | str, *columns: str) -> Column:
    """Fixed pseudo-random order: hex md5 of ``seed:value:...``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_block(order: Column) -> Column:
    """One of 4096 even blocks of a hash order, in the same order."""
    return F.substring(order, 1, 3)


def prefix_sum(
    df: DataFrame,
    value: str,
    order: list,
    out: str,
    keys: list[str] | None = None,
    coarse: list[str] | None = None,
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the same keys.

    ``coarse`` names columns that never fall along the order. Each combination
    is one block: totals of blocks are added up first, rows only inside their
    block, so no task has to see a whole group.
    """
    keys, coarse = keys or [], coarse or []
    if not coarse:
        earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    group, level = [*keys, *coarse], len(coarse)
    size, before, inside = f"_size{level}", f"_before{level}", f"_inside{level}"
    blocks = prefix_sum(
        df.groupBy(*group).agg(F.sum(value).alias(size)),
        size, [coarse[-1]], before, keys, coarse[:-1],
    ).drop(size)
    rows = prefix_sum(df, value, order, inside, group)
    return (
        rows.join(blocks, group)
        .withColumn(out, F.col(before) + F.col(inside))
        .drop(before, inside)
    )


def split_rank(
    df: DataFrame,
    order: list,
    out: str = "rank",
    keys: list[str] | None = None,
    coarse: list[str] | None = None,
) -> DataFrame:
    """1-based row number in ``order`` inside ``keys``, block by block."""
    ranked = prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", order, out, keys, coarse)
    return ranked.withColumn(out, F.col(out) + 1).drop("_one")


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """First ``k`` rows of the table; each task keeps only its own first ``k``."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; tasks cut to ``k`` before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, place).where(F.col(out) <= k)


def cap_per(df: DataFrame, keys: list[str], part: str, order: list, cap: int) -> DataFrame:
    """At most ``cap`` rows of one ``part`` inside each group's ranked list."""
    return top_k_per(df, [*keys, part], order, cap, "_place").drop("_place")


def interleave(lists: DataFrame, key: str, item: str, n: int) -> DataFrame:
    """Merge ranked lists round-robin, keep an item's first place, first ``n`` items.

    Input rows: key, list_no, rank, item.
    """
    first = lists.groupBy(key, item).agg(F.min(F.struct("rank", "list_no")).alias("_at"))
    return top_k_per(first, [key], ["_at"], n).drop("_at")


def accumulate_until(df: DataFrame, key: str, step: str, item: str, n: int) -> DataFrame:
    """Rows of the first steps that together hold at least ``n`` distinct items.

    Steps are added up in ranges of (key, step), so a key with a large part of all
    rows is spread, and its rows are salted when they meet its last step.
    """
    news = df.groupBy(key, item).agg(F.min(step).alias(step), F.count(F.lit(1)).alias("_rows")).groupBy(key, step).agg(
        F.count(F.lit(1)).alias("_new"), F.sum("_rows").alias("_rows")
    )
    steps = cut(range_prefix_sum(news, "_new", [step], "_before", [key]))
    last = steps.groupBy(key).agg(
        F.min(F.when(F.col("_before") + F.col("_new") >= n, F.col(step))).alias("_last"), F.sum("_rows").alias("_rows")
    )
    return (
        salted_join(df, last, key, "_rows", how="left")
        .where(F.col("_last").isNull() | (F.col(step) <= F.col("_last")))
        .drop("_last", "_rows")
    )


def ordered_distinct(df: DataFrame, key: str, item: str, rank: str = "rank", limit: int | None = None) -> DataFrame:
    """Keep the first place of each item and rank anew; ``limit`` cuts the list before, if given.

    Ranks of a list are unique. Places are counted in ranges of (key, rank), so one very
    long list is many tasks.
    """
    some = df if limit is None else df.where(F.col(rank) <= limit)
    first = some.groupBy(key, item).agg(F.min(rank).alias("_first"))
    return range_rank(first, ["_first"], rank, [key]).drop("_first")


def first_hit(hits: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Smallest rank with a hit."""
    return hits.groupBy(key).agg(F.min(F.when(F.col("hit"), F.col(rank))).alias("first_hit"))
