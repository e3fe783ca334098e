"""Train, dev and test sets, seed buckets and covering samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from encore.operators.profile import describe_delta
from encore.operators.ranking import hash_block, hash_order, split_rank
from encore.operators.skew import salted_join
from encore.sources.workspace import cut

SEED_COUNTS = (0, 1, 5, 10, 25, 100)


def _drawn(df: DataFrame, seed: int | str, out: str, keys: list[str] | None = None, key: str = "pid") -> DataFrame:
    """Rank rows in a fixed pseudo-random order inside ``keys``."""
    order = hash_order(seed, key)
    rows = df.withColumn("_hash", order).withColumn("_hash_block", hash_block(F.col("_hash")))
    return split_rank(rows, ["_hash", key], out, keys, ["_hash_block"]).drop("_hash", "_hash_block")


def stratified_split(features: DataFrame, strata: list[str], share: float, seed: int) -> DataFrame:
    """(pid, part): the given share of each stratum is ``test``, the rest ``train``.

    A stratum that is too small to give a test row, or has one row only, is drawn
    together with all others of that kind. A null is a stratum value like any other.
    """
    take = F.floor(F.col("_n") * share + 0.5)
    named = features.select("pid", F.to_json(F.struct(*strata)).alias("_stratum"))
    sizes = named.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"))
    drawn_as = F.when((F.col("_n") > 1) & (take >= 1), F.col("_stratum")).otherwise("rest")
    sizes = cut(sizes.withColumn("_draw", drawn_as))
    rows = salted_join(named, sizes, "_stratum", "_n").select("pid", "_draw")
    totals = sizes.groupBy("_draw").agg(F.sum("_n").alias("_n"))
    ranked = salted_join(_drawn(rows, seed, "_rank", ["_draw"]), totals, "_draw", "_n")
    return ranked.select("pid", F.when(F.col("_rank") <= take, "test").otherwise("train").alias("part"))


def missing_tracks(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test entries per playlist whose track never occurs in train (pid, missing).

    Distinct tracks are compared first; only mentions of unseen tracks are joined back.
    """
    counts = test.groupBy("track_uri").agg(F.count(F.lit(1)).alias("n"))
    unseen = counts.join(train.select("track_uri").distinct(), "track_uri", "left_anti")
    return (
        salted_join(test.select("pid", "pos", "track_uri"), unseen, "track_uri", "n")
        .groupBy("pid")
        .agg(F.count(F.lit(1)).alias("missing"))
    )


def covered_candidates(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test playlists whose every track occurs in train."""
    return test.select("pid").distinct().join(missing_tracks(test, train), "pid", "left_anti")


def draw_eval(candidates: DataFrame, seed: int, size: int | None = None) -> DataFrame:
    """(pid, part): ``size`` drawn candidates (default all), first half dev, rest test."""
    candidates = cut(candidates.select("pid"))
    ranked = _drawn(candidates, seed, "_rank")
    if size is None:
        half = F.floor(candidates.agg(F.count(F.lit(1))).scalar() / 2)
    else:
        ranked = ranked.where(F.col("_rank") <= size)
        half = F.floor(F.least(candidates.agg(F.count(F.lit(1))).scalar(), F.lit(size)) / 2)
    return ranked.select("pid", F.when(F.col("_rank") <= half, "dev").otherwise("test").alias("part"))


def train_rest(features: DataFrame, drawn: DataFrame) -> DataFrame:
    """Every playlist that was not drawn, rejected candidates included."""
    return features.select("pid").join(drawn, "pid", "left_anti")


def with_part(features: DataFrame, drawn: DataFrame) -> DataFrame:
    """(pid, part) for all playlists."""
    return features.select("pid").join(drawn, "pid", "left").select(
        "pid", F.coalesce("part", F.lit("train")).alias("part")
    )


def assign(tracks: DataFrame, playlists: DataFrame, weight: str = "num_tracks") -> DataFrame:
    """Entries of the given playlists with their columns; ``weight`` is their length."""
    return salted_join(tracks, playlists, "pid", weight).drop(weight)


def seed_buckets(lists: DataFrame, ks: tuple[int, ...] = SEED_COUNTS, seed: int = 0) -> DataFrame:
    """Add ``k``: each part is sorted by length and cut into equal chunks.

    The shortest lists get the smallest k, the remainder falls into the last
    chunk. Input (pid, part, num_tracks).
    """
    rows = lists.withColumn("_hash", hash_order(seed, "pid")).withColumn(
        "_hash_block", hash_block(F.col("_hash"))
    )
    ranked = split_rank(
        rows, ["_hash", "pid"], "_rank", ["part"], ["num_tracks", "_hash_block"]
    ).drop("_hash", "_hash_block")
    sizes = lists.groupBy("part").agg(F.floor(F.count(F.lit(1)) / len(ks)).alias("_size"))
    last = len(ks) - 1
    chunk = F.when(F.col("_size") == 0, F.lit(last)).otherwise(
        F.least(F.floor((F.col("_rank") - 1) / F.col("_size")), F.lit(last))
    )
    k = F.element_at(F.array(*map(F.lit, ks)), chunk.cast("int") + 1)
    return ranked.join(F.broadcast(sizes), "part").withColumn("k", k).drop("_rank", "_size")


def seed_truth(entries: DataFrame) -> DataFrame:
    """Flag the visible seeds: the first ``k`` entries of each list."""
    return entries.withColumn("is_seed", F.col("pos") < F.col("k"))


def covering_sample(train: DataFrame, wanted: DataFrame, share: float, seed: int) -> DataFrame:
    """(pid, reason): playlists that first hold a wanted track, filled up to ``share``.

    Going through the playlists in pid order, a playlist is taken exactly when
    it is the first holder of some wanted track.
    """
    first = train.groupBy("track_uri").agg(F.min("pid").alias("pid"))
    cover = cut(
        first.join(wanted.select("track_uri").distinct(), "track_uri", "left_semi").select("pid").distinct()
    )
    pids = cut(train.select("pid").distinct())
    rest = _drawn(cut(pids.join(cover, "pid", "left_anti")), seed, "_rank")
    size = F.floor(pids.agg(F.count(F.lit(1))).scalar() * share) - cover.agg(F.count(F.lit(1))).scalar()
    fill = rest.where(F.col("_rank") <= size)
    return cover.withColumn("reason", F.lit("cover")).unionByName(
        fill.select("pid", F.lit("fill").alias("reason"))
    )


def eval_tracks(entries: DataFrame) -> DataFrame:
    """Distinct tracks of the dev and test lists."""
    return entries.select("track_uri").distinct()


def entries_of(tracks: DataFrame, pids: DataFrame) -> DataFrame:
    """Entries of the given playlists, when their lengths are not at hand."""
    return salted_join(tracks, pids, "pid")


def split_report(train: DataFrame, dev: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics of both parts side by side for several features."""
    reports = [describe_delta(train, dev, c).withColumn("feature", F.lit(c)) for c in columns]
    return reduce(DataFrame.unionByName, reports)
