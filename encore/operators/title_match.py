"""Seeds and recommendations from playlists with a similar title."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from encore.functions.titles import title_key
from encore.operators.edit_join import THRESHOLDS, edit_nearest
from encore.operators.ranking import accumulate_until, hash_order, top_k_per
from encore.operators.skew import salted_join
from encore.sources.workspace import cut

# Fixed value: with more tied playlists than this, that many of them vote.
TIES = 100


def title_groups(playlists: DataFrame) -> DataFrame:
    """(name, tie, item): distinct title keys, ``tie`` is their first playlist by hash."""
    keyed = playlists.select("pid", title_key(F.col("name")).alias("name")).where("name is not null")
    return keyed.groupBy("name").agg(F.min(hash_order("title", "pid")).alias("tie")).select(
        "name", "tie", F.col("name").alias("item")
    )


def title_queries(lists: DataFrame) -> DataFrame:
    """(query, item): distinct title keys of the lists to complete."""
    key = title_key(F.col("name"))
    return lists.select(key.alias("query")).where("query is not null").distinct().withColumn(
        "item", F.col("query")
    )


def title_distance(lists: DataFrame, train: DataFrame, m: int = 1) -> DataFrame:
    """(query, name, distance): the ``m`` nearest distinct train titles of each title."""
    found = edit_nearest(title_groups(train), title_queries(lists), m)
    return found.select("query", "name", F.col("cost").cast("int").alias("distance"), "rank")


def _expand(found: DataFrame, lists: DataFrame, keyed: DataFrame, tie: str, m: int) -> DataFrame:
    """Turn nearest titles into the ``m`` nearest playlists of each list.

    No title can give more than ``m`` playlists to a result, so each title is
    cut to its first ``m`` before the join. Titles behind ``m`` nearer playlists give none.
    """
    members = top_k_per(keyed, ["name"], [tie], m, "_member").select(
        "name", F.col("pid").alias("candidate"), F.col(tie).alias("_tie")
    )
    sizes = keyed.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy("query").orderBy("cost").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    nearer = F.sum("_n").over(up_to) - F.sum("_n").over(Window.partitionBy("query", "cost"))
    wanted = found.select("query", "name", "cost").join(sizes, "name").withColumn("_nearer", nearer)
    per_query = salted_join(cut(wanted.where(F.col("_nearer") < m).select("query", "name", "cost")), members, "name")
    ranked = top_k_per(per_query, ["query"], ["cost", "_tie"], m).drop("name", "_tie", "_member")
    return salted_join(lists, ranked, "query").select(
        "pid", "rank", "candidate", "cost"
    )


def nearest_titles(lists: DataFrame, train: DataFrame, m: int = TIES + 1) -> DataFrame:
    """(pid, rank, candidate, distance): train playlists by edit distance of the titles.

    Equal distances go by a fixed hash of the playlist id.
    """
    keyed = train.select(
        "pid", title_key(F.col("name")).alias("name"), hash_order("title", "pid").alias("tie")
    ).where("name is not null")
    # More than the vote asks for at first is wanted only where near titles do not suffice.
    thresholds = THRESHOLDS if m <= TIES + 1 else ()
    found = edit_nearest(title_groups(train), title_queries(lists), m, thresholds)
    asked = lists.select("pid", title_key(F.col("name")).alias("query"))
    return _expand(found, asked, keyed, "tie", m).withColumnRenamed("cost", "distance")


def candidate_mentions(candidates: DataFrame, tracks: DataFrame, value: str) -> DataFrame:
    """(pid, rank, value, track_uri, n, pos): tracks of the candidate playlists.

    Other playlists are dropped first, and a candidate is reduced to its
    distinct tracks before the join.
    """
    chosen = cut(candidates.select(F.col("candidate").alias("pid")).distinct())
    mentions = tracks.join(chosen, "pid", "left_semi").groupBy(F.col("pid").alias("candidate"), "track_uri").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")
    )
    wanted = candidates.select("pid", "rank", value, "candidate")
    return salted_join(mentions, wanted, "candidate").select("pid", "rank", value, "track_uri", "n", "pos")


def _tied(near: DataFrame) -> DataFrame:
    """(pid, _tied, _found): whether more than 100 playlists tie at the smallest distance."""
    return near.groupBy("pid").agg(
        F.min("distance").alias("_low"),
        F.max(F.when(F.col("rank") == TIES + 1, F.col("distance"))).alias("_next"),
        F.max("rank").alias("_found"),
    ).select("pid", F.coalesce(F.col("_next") == F.col("_low"), F.lit(False)).alias("_tied"), "_found")


def voting_titles(
    lists: DataFrame, train: DataFrame, tracks: DataFrame, seed_k: int = 100, m: int = TIES + 1
) -> DataFrame:
    """(pid, rank, candidate, distance): as many nearest playlists as the vote needs.

    Lists whose first ``m`` candidates hold fewer than ``seed_k`` distinct tracks are
    searched again with four times as many, until they hold enough or no train
    playlist is left. The number of searches grows with the logarithm of the table.
    """
    parts, asked, m = [], lists, max(m, TIES + 1)
    while True:
        near = cut(nearest_titles(asked, train, m))
        open_lists = _tied(near).where((F.col("_found") == m) & ~F.col("_tied")).select("pid")
        held = (
            candidate_mentions(near.join(open_lists, "pid", "left_semi"), tracks, "distance")
            .select("pid", "track_uri").distinct().groupBy("pid").agg(F.count(F.lit(1)).alias("_held"))
        )
        short = cut(open_lists.join(held.where(F.col("_held") >= seed_k), "pid", "left_anti"))
        parts.append(near.join(short, "pid", "left_anti"))
        if short.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        asked, m = asked.join(short, "pid", "left_semi"), 4 * m


def vote_by_title(near: DataFrame, tracks: DataFrame, seed_k: int = 100) -> DataFrame:
    """(pid, rank, track_uri, score): tracks by mentions in the nearest playlists.

    With more than 100 playlists tied at the smallest distance, 100 of them vote.
    Otherwise the given playlists vote in order until they hold ``seed_k`` distinct tracks.
    """
    spread = _tied(near).drop("_found")
    voters = near.join(spread, "pid").where(~F.col("_tied") | (F.col("rank") <= TIES)).drop("_tied")
    mentions = candidate_mentions(voters, tracks, "distance").join(spread, "pid")
    walked = accumulate_until(mentions.where(~F.col("_tied")), "pid", "rank", "track_uri", seed_k)
    used = mentions.where("_tied").unionByName(walked)
    votes = used.groupBy("pid", "track_uri").agg(
        F.sum("n").alias("score"), F.min(F.struct("rank", "pos")).alias("_first")
    )
    return top_k_per(votes, ["pid"], [F.desc("score"), "_first", "track_uri"], seed_k).select(
        "pid", "rank", "track_uri", F.col("score").cast("double").alias("score")
    )


def title_seeds(lists: DataFrame, train: DataFrame, tracks: DataFrame, seed_k: int = 100) -> DataFrame:
    """Seeds for lists without any, from similar titles."""
    return title_recommend(lists.where("k = 0"), train, tracks, seed_k)


def title_recommend(lists: DataFrame, train: DataFrame, tracks: DataFrame, n: int = 500) -> DataFrame:
    """The same vote as a recommender for every bucket.

    Only the title decides a vote, so each distinct title votes once and all its lists get
    the result. ``lists`` has one row per playlist.
    """
    asked = cut(lists.select("pid", title_key(F.col("name")).alias("title")).where("pid is not null and title is not null"))
    titles = asked.select(F.col("title").alias("pid"), F.col("title").alias("name")).distinct()
    votes = cut(vote_by_title(voting_titles(titles, train, tracks, n), tracks, n).withColumnRenamed("pid", "title"))
    return salted_join(asked, votes, "title").select("pid", "rank", "track_uri", "score")
