"""Nearest texts by edit distance through an index of their pieces.

A text within t edits of a query has one of its t + 1 pieces unchanged somewhere near the same
place of the query. So texts and queries meet by equality of pieces, and only these
pairs are compared. The threshold is raised until a query has enough texts; the queries that never
have are few where near texts are many, and are compared with all texts in blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from encore.operators.nearest import nearest
from encore.operators.ranking import top_k_per
from encore.sources.workspace import cut

THRESHOLDS = (1, 3)
# A piece has so many characters at least; shorter ones would meet nearly everything.
PIECE = 2


def text_pieces(texts: DataFrame, t: int) -> DataFrame:
    """(name, key): a hash of length, number and text for each of the t + 1 pieces of ``item``."""
    size = F.char_length("item")
    rows = texts.select("name", "item", size.alias("_l"), F.explode(F.sequence(F.lit(0), F.lit(t))).alias("_i"))
    start, end = (F.floor((F.col("_i") + k) * F.col("_l") / (t + 1)).cast("int") for k in (0, 1))
    piece = F.substring("item", start + 1, end - start)
    return rows.where(F.col("_l") >= PIECE * (t + 1)).select("name", F.xxhash64("_l", "_i", piece).alias("key"))


def query_pieces(queries: DataFrame, t: int) -> DataFrame:
    """(query, key): the pieces that a text within ``t`` edits can have in the query.

    With i pieces before it and t - i behind, a piece has moved by at most i, and as seen
    from the end by at most t - i; else another piece is unchanged as well.
    """
    size = F.char_length("item")
    rows = queries.select("query", "item", size.alias("_m"), F.explode(F.sequence(size - t, size + t)).alias("_l"))
    rows = rows.where(F.col("_l") >= PIECE * (t + 1)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(t))))
    start, end = (F.floor((F.col("_i") + k) * F.col("_l") / (t + 1)).cast("int") for k in (0, 1))
    gap = F.col("_m") - F.col("_l")
    low = F.greatest(F.greatest(-F.col("_i"), gap - t + F.col("_i")) + start, F.lit(0))
    high = F.least(F.least(F.col("_i"), gap + t - F.col("_i")) + start, F.col("_m") - (end - start))
    rows = rows.withColumns({"_low": low, "_high": high, "_size": end - start}).where("_low <= _high")
    rows = rows.withColumn("_at", F.explode(F.sequence("_low", "_high")))
    piece = F.substring("item", F.col("_at") + 1, F.col("_size"))
    return rows.select("query", F.xxhash64("_l", "_i", piece).alias("key")).distinct()


def candidates(texts: DataFrame, queries: DataFrame, t: int) -> DataFrame:
    """(name, query): distinct pairs that share a piece, among them all within ``t`` edits.

    A piece that very many texts share is left to the skew handling of adaptive joins.

    ``texts`` has (name, item), ``queries`` (query, item) of at least ``PIECE`` * (t + 1) + t characters.
    """
    met = text_pieces(texts, t).join(query_pieces(queries, t), "key")
    return met.select("name", "query").distinct()


def within(texts: DataFrame, queries: DataFrame, t: int) -> DataFrame:
    """(query, name, cost): all pairs of at most ``t`` edits; see ``candidates``."""
    pairs = candidates(texts, queries, t)
    asked = queries.select("query", F.col("item").alias("_asked"))
    both = pairs.join(texts.select("name", "item"), "name").join(asked, "query")
    cost = F.levenshtein("_asked", "item", t)
    return both.withColumn("cost", cost.cast("double")).where("cost >= 0").select("query", "name", "cost")


def edit_nearest(base: DataFrame, queries: DataFrame, k: int, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(query, name, tie, cost, rank): the ``k`` texts of least edit distance to each query.

    ``base`` has distinct (name, tie, item), ``queries`` distinct (query, item); ``tie``
    orders equal distances. Exact for any text: what the thresholds leave open, and queries too
    short to be cut, go through ``nearest``.
    """
    base = cut(base.select("name", "tie", "item"))
    asked, done = cut(queries.select("query", "item")), []
    for t in thresholds:
        long = asked.where(F.char_length("item") >= PIECE * (t + 1) + t)
        near = within(base, long, t).join(base.select("name", "tie"), "name").select("query", "name", "tie", "cost")
        best = cut(top_k_per(near, ["query"], ["cost", "tie", "name"], k))
        full = best.where(F.col("rank") == k).select("query")
        done.append(best.join(full, "query", "left_semi"))
        asked = cut(asked.join(full, "query", "left_anti"))
    if not asked.isEmpty() or not done:
        done.append(nearest(base, asked, k).select("query", "name", "tie", "cost", "rank"))
    return reduce(DataFrame.unionByName, done)
