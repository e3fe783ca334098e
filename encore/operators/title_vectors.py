"""Seeds and recommendations from averaged word vectors of titles."""

from __future__ import annotations

import math

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from encore.functions.titles import Terms, title_tokens
from encore.functions.vectors import mean_vector, norm
from encore.operators.bounded_search import search
from encore.operators.ranking import top_k_per
from encore.operators.skew import salted_join
from encore.operators.title_match import _expand, candidate_mentions
from encore.sources.workspace import cut


def title_vectors(names: DataFrame, words: DataFrame, slang: Terms, emoji: Terms) -> DataFrame:
    """(name, vec): mean vector of the known tokens of each distinct title.

    ``names`` has ``name``, ``words`` (token, vec). Titles without a known token
    drop out. The list per title is bounded by the title itself.
    """
    tokens = (
        names.select("name").where("name is not null").distinct()
        .select("name", F.posexplode(title_tokens(F.col("name"), slang, emoji)).alias("at", "token"))
        .where("token <> ''")
    )
    known = salted_join(cut(tokens), words, "token")
    gathered = known.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("token", "at", "vec"))).alias("_v"))
    return gathered.select("name", mean_vector(F.transform("_v", lambda v: v["vec"])).alias("vec"))


def unit(vectors: DataFrame, column: str = "vec") -> DataFrame:
    """Scale vectors to length 1; vectors without length drop out."""
    size = norm(column)
    return vectors.where(size > 0).withColumn(column, F.transform(column, lambda x: x / size))


def vector_table(playlists: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pid, name, vec): playlists with a title vector, spread by title and playlist."""
    return salted_join(playlists.select("pid", "name"), vectors, "name")


def similar_playlists(lists: DataFrame, train: DataFrame, vectors: DataFrame, k: int = 100) -> DataFrame:
    """(pid, rank, candidate, similarity): train playlists by cosine of the title vectors.

    ``vectors`` holds (name, vec) for the titles of both sides. Titles are
    compared once; equal similarities go by playlist id.
    """
    scaled = cut(unit(vectors))
    base = (
        train.where("name is not null").groupBy("name").agg(F.min("pid").alias("tie"))
        .join(scaled, "name").select("name", "tie", F.col("vec").alias("item"))
    )
    queries = (
        lists.select("name").distinct().join(scaled, "name")
        .select(F.col("name").alias("query"), F.col("vec").alias("item"))
    )
    found, _ = search(base, queries, k)
    keyed = train.where("name is not null").select("pid", "name", F.col("pid").alias("tie"))
    asked = lists.select("pid", F.col("name").alias("query"))
    return _expand(found, asked, keyed, "tie", k).select(
        "pid", "rank", "candidate", (F.lit(0.0) - F.col("cost")).alias("similarity")
    )


def hash_tables(least: float, recall: float, ratio: float) -> int:
    """Tables of random projections of which one holds a pair of cosine ``least`` with probability ``recall``.

    Buckets are ``ratio`` times as wide as the distance of such a pair along a projection.
    """
    normal = 0.5 * (1 + math.erf(ratio / math.sqrt(2)))
    met = 2 * normal - 1 - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def similar_playlists_approx(
    lists: DataFrame, train: DataFrame, vectors: DataFrame, k: int = 100,
    least: float = 0.9, recall: float = 0.95, ratio: float = 1.0, seed: int = 17,
) -> DataFrame:
    """(pid, rank, candidate, similarity): the up to ``k`` nearest train playlists with a cosine of ``least`` or more.

    Titles meet in buckets of random projections, so of the pairs at the limit a share of about
    ``recall`` is found, of closer ones more; what is returned has its exact cosine. Distinct
    titles are compared, so a hot title is one vector. Lists without such a neighbour have no
    rows. The exact form is :func:`similar_playlists`.
    """
    scaled = cut(unit(vectors))
    size = scaled.agg(F.max(F.size("vec"))).first()[0]
    if not size:
        return scaled.select(
            F.lit(0).cast("long").alias("pid"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("candidate"), F.lit(0.0).alias("similarity")
        ).limit(0)
    dense = scaled.select("name", array_to_vector("vec").alias("v"))
    base = dense.join(train.select("name").where("name is not null").distinct(), "name")
    queries = dense.join(lists.select("name").distinct(), "name").withColumnRenamed("name", "query")
    distance = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    model = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="hashes", seed=seed, numHashTables=hash_tables(least, recall, ratio),
        bucketLength=ratio * distance / math.sqrt(size),
    ).fit(base)
    met = model.approxSimilarityJoin(queries, base, distance, "distance")
    found = met.select(
        F.col("datasetA.query").alias("query"), F.col("datasetB.name").alias("name"),
        (F.col("distance") * F.col("distance") / 2 - 1).alias("cost"),
    )
    nearest = top_k_per(found, ["query"], ["cost", "name"], k).drop("rank")
    keyed = train.where("name is not null").select("pid", "name", F.col("pid").alias("tie"))
    return _expand(nearest, lists.select("pid", F.col("name").alias("query")), keyed, "tie", k).select(
        "pid", "rank", "candidate", (F.lit(0.0) - F.col("cost")).alias("similarity")
    )


def vote_by_similarity(similar: DataFrame, tracks: DataFrame, k: int = 100) -> DataFrame:
    """(pid, rank, track_uri, score): tracks by summed similarity over their mentions.

    Sums are of decimals with twelve places, so they do not depend on the order of addition.
    """
    mentions = candidate_mentions(similar, tracks, "similarity")
    votes = mentions.groupBy("pid", "track_uri").agg(
        F.sum((F.col("similarity") * F.col("n")).cast("decimal(26,12)")).alias("score"),
        F.min(F.struct("rank", "pos")).alias("_first"),
    )
    return top_k_per(votes, ["pid"], [F.desc("score"), "_first", "track_uri"], k).select(
        "pid", "rank", "track_uri", F.col("score").cast("double").alias("score")
    )


def fill_seeds(lists: DataFrame, by_vector: DataFrame, by_title: DataFrame) -> DataFrame:
    """(pid, rank, track_uri, source): seeds for lists with k = 0.

    Vector seeds are used where there are any, else title seeds.
    """
    cold = lists.where("k = 0").select("pid")
    first = by_vector.join(cold, "pid", "left_semi").select("pid", "rank", "track_uri")
    rest = cold.join(first.select("pid").distinct(), "pid", "left_anti")
    second = by_title.join(rest, "pid", "left_semi").select("pid", "rank", "track_uri")
    return first.withColumn("source", F.lit("vector")).unionByName(
        second.withColumn("source", F.lit("title"))
    )


def vector_recommend(
    lists: DataFrame, train: DataFrame, vectors: DataFrame, tracks: DataFrame, k: int = 500
) -> DataFrame:
    """Vote over the ``k`` most similar playlists as a recommender."""
    return vote_by_similarity(similar_playlists(lists, train, vectors, k), tracks, k)
