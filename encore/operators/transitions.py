"""Next-item transitions and sequence continuation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from encore.operators.ranking import top_k_per
from encore.operators.segments import next_items
from encore.operators.skew import SALTS, heavy_keys, salted_join
from encore.sources.workspace import cut


def fit_transitions(tracks: DataFrame, max_gap: int = 1) -> DataFrame:
    """(prev, next, n, total, p): how often ``next`` follows ``prev``.

    Pairs are shuffled once, by ``prev``, then counted and totalled in place. The pairs of a
    ``prev`` with a large part of all entries are dealt out by ``next`` and totalled across.
    """
    heavy = heavy_keys(cut(tracks.groupBy("track_uri").agg(F.count(F.lit(1)).alias("_n"))), "track_uri", "_n")
    pairs = next_items(tracks, "track_uri", max_gap).where("prev is not null").select("prev", "next")
    if not heavy:
        counted = pairs.repartition("prev").groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))
        rows = counted.withColumn("total", F.sum("n").over(Window.partitionBy("prev")))
    else:
        known = tracks.sparkSession.createDataFrame(heavy, tracks.select("track_uri").schema)
        marks = F.broadcast(known.select(F.col("track_uri").alias("prev"), F.lit(SALTS).alias("_salts")))
        salt = F.pmod(F.xxhash64("next"), F.coalesce("_salts", F.lit(1)))
        counted = cut(
            pairs.join(marks, "prev", "left").withColumn("_salt", salt).repartition("prev", "_salt")
            .groupBy("prev", "_salt", "next").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("_part", F.sum("n").over(Window.partitionBy("prev", "_salt")))
        )
        across = counted.join(marks, "prev").groupBy("prev").agg(F.sum("n").alias("_all"))
        rows = counted.join(F.broadcast(across), "prev", "left").withColumn("total", F.coalesce("_all", "_part"))
    return rows.select("prev", "next", "n", "total", (F.col("n") / F.col("total")).alias("p"))


def prune_transitions(transitions: DataFrame, top: int) -> DataFrame:
    """Only the ``top`` best candidates of each step."""
    return top_k_per(transitions, ["prev"], [F.desc("n"), "next"], top)


def best_next(transitions: DataFrame) -> DataFrame:
    """(prev, next, p, total): the most likely next item; ties go to the smaller item."""
    return transitions.groupBy("prev").agg(
        F.min_by(F.struct("next", "p", "total"), F.struct(-F.col("n"), F.col("next"))).alias("_b")
    ).select("prev", "_b.next", "_b.p", "_b.total")


def score_accumulate(step_scores: DataFrame, seeds: DataFrame, n: int = 500) -> DataFrame:
    """Sum the step scores of each candidate, drop seeds, keep the best ``n``.

    Input step_scores (pid, track_uri, score), seeds (pid, track_uri). Sums are of decimals
    with twelve places, so they do not depend on the order of addition.
    """
    summed = step_scores.groupBy("pid", "track_uri").agg(F.sum(F.col("score").cast("decimal(26,12)")).alias("score"))
    fresh = summed.join(seeds.select("pid", "track_uri").distinct(), ["pid", "track_uri"], "left_anti")
    return top_k_per(fresh, ["pid"], [F.desc("score"), "track_uri"], n).select(
        "pid", "rank", "track_uri", F.col("score").cast("double").alias("score")
    )


def _known_seeds(seeds: DataFrame, transitions: DataFrame) -> DataFrame:
    """(pid, prev, weight): seeds with a known continuation, weights of a playlist sum to 1."""
    mentions = seeds.groupBy("pid", F.col("track_uri").alias("prev")).agg(F.count(F.lit(1)).alias("m"))
    known = transitions.groupBy("prev").agg(F.max("total").alias("total"))
    usable = salted_join(mentions, known, "prev", "total").drop("total")
    sizes = usable.groupBy("pid").agg(F.sum("m").alias("of"))
    return cut(usable.join(sizes, "pid").select("pid", "prev", (F.col("m") / F.col("of")).alias("weight")))


def _steps(weights: DataFrame, transitions: DataFrame) -> DataFrame:
    """Step scores of one hop: weight times transition probability."""
    return salted_join(weights, transitions, "prev").select(
        "pid", F.col("next").alias("track_uri"), (F.col("weight") * F.col("p")).alias("score")
    )


def continue_full(seeds: DataFrame, transitions: DataFrame, n: int = 500) -> DataFrame:
    """Fully guided: every step starts from a seed drawn evenly; expected scores."""
    return score_accumulate(_steps(_known_seeds(seeds, transitions), transitions), seeds, n)


def continue_semi(seeds: DataFrame, transitions: DataFrame, n: int = 500, hops: int = 2) -> DataFrame:
    """Semi-guided: after a seed, ``hops - 1`` steps follow the best prediction of the step before.

    All steps count alike. With one hop this is ``continue_full``. The weights of each
    further hop are one sparse product with the table of best items; they are
    written, so a later hop does not repeat an earlier one, and no playlist ever has more
    of them than it has seeds. Weight without a known continuation ends there.
    """
    if hops < 1:
        raise ValueError("at least one hop")
    weights = _known_seeds(seeds, transitions)
    steps = _steps(weights, transitions)
    best = cut(best_next(transitions).select("prev", "next", "total")) if hops > 1 else None
    for _ in range(hops - 1):
        weights = cut(
            salted_join(weights, best, "prev", "total")
            .groupBy("pid", F.col("next").alias("prev"))
            .agg(F.sum("weight").alias("weight"))
        )
        steps = steps.unionByName(_steps(weights, transitions))
    return score_accumulate(steps.withColumn("score", F.col("score") / hops), seeds, n)


def next_item(seeds: DataFrame, transitions: DataFrame) -> DataFrame:
    """Most likely item behind the last seed of each playlist.

    Only the transitions of last seeds are compared.
    """
    last = cut(seeds.groupBy("pid").agg(F.max_by("track_uri", "pos").alias("prev")))
    asked = transitions.join(last.select("prev").distinct(), "prev", "left_semi")
    return salted_join(last, best_next(asked), "prev", "total").select("pid", "prev", "next", "p")


def _held_out_pairs(tracks: DataFrame) -> DataFrame:
    return next_items(tracks).groupBy("prev", "next").agg(F.count(F.lit(1)).alias("m"))


def sequence_accuracy(tracks: DataFrame, transitions: DataFrame) -> DataFrame:
    """Share of positions whose most likely next item is the true one."""
    pairs = _held_out_pairs(tracks).withColumnRenamed("next", "y")
    best = best_next(transitions).select("prev", "next", "total")
    scored = salted_join(pairs, best, "prev", "total", how="left")
    hits = F.sum(F.when(F.col("next") == F.col("y"), F.col("m")).otherwise(0))
    return scored.agg(F.sum("m").alias("positions"), hits.alias("hits")).withColumn(
        "accuracy", F.col("hits") / F.col("positions")
    )


def sequence_loss(tracks: DataFrame, transitions: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Mean cross-entropy of the true next item; unseen pairs count as ``eps``."""
    pairs = _held_out_pairs(tracks)
    scored = pairs.join(transitions.select("prev", "next", "p"), ["prev", "next"], "left")
    loss = -F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(eps)))
    return scored.agg(
        F.sum("m").alias("positions"), (F.sum(loss * F.col("m")) / F.sum("m")).alias("loss")
    )
