"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from encore.sources.workspace import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node each linked node can reach, roots included.

    Two steps alternate until nothing changes: every node hangs its larger
    neighbours on its smallest one, then every node hangs its smaller neighbours
    on the smallest. Both are a grouped minimum, combined in the map tasks, and a
    join that adaptive execution splits, so no node gathers its neighbours in one
    task. Links with a null end and links of a node to itself are left out. The
    number of rounds grows with the logarithm of the longest chain.
    """
    pair = F.least(a, b), F.greatest(a, b)
    edges = cut(
        links.where(F.col(a) != F.col(b)).select(pair[1].alias("u"), pair[0].alias("v")).distinct()
    )
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        )
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
        edges = cut(small.where("u > v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
