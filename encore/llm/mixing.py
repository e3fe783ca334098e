"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from encore.operators.ranges import range_prefix_sum, range_rank
from encore.sources.workspace import cut

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
# Hash blocks of a (source, size): at least so many, and one for so many documents of the table.
BLOCKS, BLOCK_ROWS = 64, 50_000


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, weights: tuple[float, ...] = (1, 2, 3), most: float = MAX_REPEATS) -> DataFrame:
    """``sizes`` (one row per source) with ``_target``: by weight, all sizes together.

    Sources by code point, null last, take the weights in turn. Targets stop at ``most`` times
    a source's size; what such a source cannot take is shared by weight among the others,
    until none is above. With the sources in rising order of size over weight that level is
    the largest rest a unit of weight over all ways to close the first few of them, so two
    prefix sums and one aggregate find it; sources without words get 0. Nothing of the
    sources comes to the driver.
    """
    ordered = range_rank(sizes.withColumn("_null", F.col(source).isNull()).withColumn("_name", F.col(source).cast("string")), ["_null", "_name"], "_at")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ordered.withColumn("_weight", F.get(turn, (F.pmod(F.col("_at") - 1, F.lit(len(weights)))).cast("int"))).withColumn(
        "_full", F.col(size) / F.col("_weight")
    )
    asked = weighed.where(F.col(size) > 0).select("_full", "_null", "_name", "_weight", F.col(size).alias("_words"))
    order = ["_full", "_null", "_name"]
    closed = range_prefix_sum(range_prefix_sum(asked, "_words", order, "_closed"), "_weight", order, "_gone")
    words, weight = asked.agg(F.sum("_words")).scalar(), asked.agg(F.sum("_weight")).scalar()
    rest = closed.select(((words - most * F.col("_closed")) / (weight - F.col("_gone"))).alias("_rest"))
    target = F.least(F.col("_weight") * rest.agg(F.max("_rest")).scalar(), F.lit(float(most)) * F.col(size))
    return weighed.select(*sizes.columns, F.when(F.col(size) > 0, target).otherwise(0.0).alias("_target"))


def rates(groups, most: float = MAX_REPEATS):
    """Expected copies of the documents of each (source, size), largest sizes first.

    The documents of a size are expected to take their share of what the target still asks
    for, given what the sampling has taken of the larger ones: the expectation over the
    random offset stays target over source size for each, and the small documents make up
    for the large ones.
    """
    import pandas as pd

    groups = groups.sort_values("_z", ascending=False)
    offset = float(groups["_offset"].iloc[0])
    wanted, left, at = float(groups["_target"].iloc[0]), int(groups["_source_size"].iloc[0]), 0.0
    out = []
    for size, n in zip(groups["_z"].tolist(), groups["_n"].tolist()):
        rate = min(most, max(0.0, wanted / left)) if size else 0.0
        out.append((rate, at))
        taken = math.floor(at + n * rate + offset) - math.floor(at + offset)
        wanted -= taken * size
        left -= n * size
        at = (at + n * rate) % 1.0
    return pd.DataFrame(
        {
            "_g": groups["_g"], "_z": groups["_z"], "_source_size": groups["_source_size"], "_target": groups["_target"],
            "_rate": [r for r, _ in out], "_from": [a for _, a in out],
        }
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    seed: int = 11,
) -> DataFrame:
    """All rows with (size, source_size, target, copies): how often the mix takes each.

    A document's expected copies are what its source's target still asks for, over what is
    left of the source, and at most three (:func:`rates`). They are summed over the source's
    documents from the largest to the smallest; one random offset is added, and a document
    is emitted once for each integer between the sums before and after it. The words taken
    differ from the target by little more than the smallest documents, unless a document
    is as large as the target. Sizes are counted in words; documents and sources without
    words take no part (copies 0). Columns with the new names are replaced. Ties are ordered
    by key and text, so reruns agree; equal rows may swap places.

    Rates need the number of documents of each (source, size) only: one group per source,
    with a row per distinct size. Ranks go by blocks of a hash within a size, then by rows
    inside a block. There are as many blocks as the number of documents asks for, so neither
    a source nor a size with a third of all rows meets in one task at any scale. Documents
    get what belongs to their source by the join of their block, so a hot source is spread
    there too.
    """
    new = ("size", "source_size", "target", "copies")
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c not in new]).alias("row"), F.col(key).alias("key"),
        F.concat(F.col(source).isNull().cast("int").cast("string"), F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("_g"),
        word_count(text).alias("_z"), F.xxhash64(F.col(text)).alias("tie"),
    )
    sized = cut(
        docs.groupBy(F.col(source).alias("_source"), word_count(text).alias("_z")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_g", F.concat(F.col("_source").isNull().cast("int").cast("string"), F.coalesce(F.col("_source").cast("string"), F.lit(""))))
    )
    n = sized.agg(F.sum("_n")).first()[0] or 0
    blocks = max(BLOCKS, -(-n // BLOCK_ROWS))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("key", "tie"), F.lit(blocks)))
    per_source = sized.groupBy("_source", "_g").agg(F.sum(F.col("_z") * F.col("_n")).alias("_source_size"))
    wanted = targets(per_source, "_source", "_source_size", weights).select("_g", "_source_size", "_target")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rated = sized.select("_g", "_z", "_n").join(wanted, "_g").withColumn("_offset", offset).groupBy("_g").applyInPandas(
        lambda g: rates(g), "_g string, _z bigint, _source_size bigint, _target double, _rate double, _from double"
    )
    before = Window.partitionBy("_g", "_z").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("_g", "_z", "_block").agg(F.count(F.lit(1)).alias("_n")).select(
        "_g", "_z", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier")
    )
    inside = Window.partitionBy("_g", "_z", "_block").orderBy("key", "tie")
    placed = rows.withColumn("_in", F.row_number().over(inside)).join(earlier.join(rated, ["_g", "_z"]), ["_g", "_z", "_block"])
    end = F.col("_earlier") + F.col("_in")
    copies = F.floor(F.col("_from") + end * F.col("_rate") + offset) - F.floor(F.col("_from") + (end - 1) * F.col("_rate") + offset)
    return placed.select(
        "row.*", F.col("_z").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        copies.cast("long").alias("copies"),
    )
