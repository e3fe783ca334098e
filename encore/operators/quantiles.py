"""Exact quantiles of a column of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from encore.operators.ranking import prefix_sum
from encore.sources.workspace import cut

BLOCKS = 256
# Distinct values that one task may hold; beyond it ranks are found block by block.
ONE_TASK = 1_000_000


def quantile_row(
    df: DataFrame, column: str, probs: list[float], names: list[str], one_task: int = ONE_TASK
) -> DataFrame:
    """One row of linearly interpolated quantiles.

    Distinct values are counted in one pass. If they are few, one aggregate
    over the counts gives the quantiles.
    """
    values = cut(
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if values.count() > one_task:
        return _by_blocks(values, probs, names)
    found = values.agg(F.percentile("value", [float(p) for p in probs], F.col("n")).alias("q"))
    return found.select(*[F.col("q")[i].alias(name) for i, name in enumerate(names)])


def _by_blocks(values: DataFrame, probs: list[float], names: list[str]) -> DataFrame:
    """Quantiles of counted values of which no task sees more than a block.

    A sketch cuts the values into blocks of about equal size, block totals and
    places inside a block give every value its rank, and the rows at the wanted
    ranks are picked.
    """
    cuts = values.agg(
        F.percentile_approx("value", [i / BLOCKS for i in range(1, BLOCKS)], 4 * BLOCKS)
    ).scalar()
    blocks = values.withColumn("cuts", cuts).select(
        "value", "n", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("block")
    )
    last = values.agg(F.sum("n") - 1).scalar()
    placed = prefix_sum(blocks, "n", ["value"], "below", [], ["block"]).withColumn("last", last)
    picks = [F.max("last").alias("last")]
    for prob, name in zip(probs, names):
        place = F.col("last") * F.lit(float(prob))
        for rank, side in ((F.floor(place), "low"), (F.ceil(place), "high")):
            hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"{name}_{side}"))
    cells = []
    for prob, name in zip(probs, names):
        place = F.col("last") * F.lit(float(prob))
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        cells.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return placed.agg(*picks).select(*cells)


def quantiles(df: DataFrame, column: str, probs: list[float]) -> DataFrame:
    """Rows (prob, value)."""
    names = [f"q{i}" for i in range(len(probs))]
    cells = [F.struct(F.lit(float(p)).alias("prob"), F.col(n).alias("value")) for p, n in zip(probs, names)]
    return quantile_row(df, column, probs, names).select(F.inline(F.array(*cells)))
