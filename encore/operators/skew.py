"""Joins that survive a key holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from encore.sources.workspace import cut

# A key is heavy when it has more than 1/256 of the total weight, so there are
# fewer than 256 heavy keys however large the data is.
HEAVY = 256
SALTS = 64


def heavy_keys(sizes: DataFrame, on: str, weight: str) -> list:
    """Heavy keys of a table with one row per key; always fewer than 256."""
    total = sizes.agg(F.sum(weight)).scalar()
    return sizes.where(F.col(weight) * F.lit(HEAVY) > total).select(on).collect()


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str,
    weight: str | None = None,
    how: str = "inner",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join ``fact`` to ``dim``, spreading the rows of heavy keys over salts.

    ``weight`` says how many rows of ``fact`` a key meets. It is a column of
    ``dim``, which then has one row per key, or of ``sizes`` (key, weight).
    Without it the keys of ``fact`` are counted. Without heavy keys this is a
    plain join; else only the few heavy rows of ``dim`` are copied and only the
    list of heavy keys is broadcast.
    """
    if weight is None:
        weight = "_n"
        sizes = cut(fact.groupBy(on).agg(F.count(F.lit(1)).alias(weight)))
    elif sizes is None:
        sizes = dim = cut(dim)
    heavy = heavy_keys(sizes, on, weight)
    if not heavy:
        return fact.join(dim, on, how)
    known = fact.sparkSession.createDataFrame(heavy, sizes.select(on).schema)
    marks = F.broadcast(known.withColumn("_salts", F.lit(SALTS)))
    salts = F.coalesce("_salts", F.lit(1))
    left = (
        fact.join(marks, on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*fact.columns), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        dim.join(marks, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [on, "_salt"], how).drop("_salt")
