"""R-precision, NDCG, clicks and recall as set-based jobs.

``recs`` has (pid, rank, track_uri) and ``truth`` (pid, pos, track_uri), where
``pos`` counts the hidden entries from 0. Other columns of the keys, such as
``method`` or ``k``, are named in ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from encore.operators.profile import bucket_means

# Fixed value: recommendations that count.
CUT = 500
METRICS = ["r_prec", "ndcg", "clicks", "recall"]


def relevance(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """Add ``hit``: 1 if the recommended track is in the truth."""
    known = truth.select("pid", "track_uri").distinct().withColumn("_known", F.lit(1))
    return recs.join(known, ["pid", "track_uri"], "left").withColumn(
        "hit", F.coalesce("_known", F.lit(0))
    ).drop("_known")


def _gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def _ideal(n: Column) -> Column:
    places = F.when(n > 0, F.sequence(F.lit(1), n.cast("int")))
    return F.aggregate(places, F.lit(0.0), lambda s, i: s + _gain(i))


def per_playlist_metrics(recs: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All metrics per playlist; lists without truth or predictions drop out."""
    by = by or []
    items = truth.groupBy("pid", "track_uri").agg(
        F.count(F.lit(1)).alias("mentions"), F.min("pos").alias("first")
    )
    sizes = items.groupBy("pid").agg(
        F.sum("mentions").alias("n_truth"), F.count_if(F.col("first") < CUT).alias("n_ideal")
    )
    known = items.select("pid", "track_uri", F.lit(1).alias("_known"))
    placed = (
        recs.join(sizes, "pid")
        .groupBy(*by, "pid", "track_uri", "n_truth", "n_ideal")
        .agg(
            F.min("rank").alias("first"),
            F.count_if(F.col("rank") <= F.col("n_truth")).alias("in_front"),
        )
        .join(known, ["pid", "track_uri"], "left")
        .withColumn("hit", F.coalesce("_known", F.lit(0)))
    )
    counted = F.when(F.col("first") <= CUT, F.col("first"))
    order = Window.partitionBy(*by, "pid").orderBy(F.asc_nulls_last("_counted"))
    ranked = placed.withColumn("_counted", counted).withColumn("place", F.row_number().over(order))
    shown = F.col("hit") * F.col("_counted").isNotNull().cast("int")
    dcg = F.sum(F.when(shown == 1, _gain(F.col("place"))).otherwise(0.0))
    click = F.min(F.when(shown == 1, F.floor((F.col("_counted") - 1) / 10)))
    return ranked.groupBy(*by, "pid", "n_truth", "n_ideal").agg(
        F.sum(F.col("hit") * F.col("in_front")).alias("_front"),
        dcg.alias("dcg"),
        F.coalesce(click, F.lit(CUT // 10 + 1)).cast("double").alias("clicks"),
        F.sum("hit").alias("_hits"),
    ).select(
        *by,
        "pid",
        (F.col("_front") / F.col("n_truth")).alias("r_prec"),
        "dcg",
        (F.col("dcg") / _ideal(F.col("n_ideal"))).alias("ndcg"),
        "clicks",
        (F.col("_hits") / F.col("n_truth")).alias("recall"),
    )


def evaluate(metrics: DataFrame, bucket: str = "k", exclude_cold: bool = False) -> DataFrame:
    """Means per bucket and the mean of the bucket means."""
    if exclude_cold:
        metrics = metrics.where(F.col(bucket) > 0)
    return bucket_means(metrics, bucket, METRICS)


def evaluate_micro(metrics: DataFrame) -> DataFrame:
    """One mean over all playlists."""
    return metrics.agg(*[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n"))


def paired_difference(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Mean, deviation and t of the per-playlist difference of two methods."""
    rows = metrics.where(F.col("method").isin(a, b)).groupBy("pid").agg(
        *[F.max(F.when(F.col("method") == x, F.col(m))).alias(f"{m}_{s}") for m in METRICS for s, x in (("a", a), ("b", b))]
    )
    cells = [
        F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_a") - F.col(f"{m}_b")).alias("d")) for m in METRICS
    ]
    diffs = rows.select(F.inline(F.array(*cells))).where(F.col("d").isNotNull())
    one = diffs.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std")
    )
    error = F.nullif(F.col("std") / F.sqrt("n"), F.lit(0.0))
    return one.withColumn("t", F.col("mean") / error)


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Mean of the bucket means per method, best NDCG first."""
    means = metrics.groupBy("method", "k").agg(*[F.avg(m).alias(m) for m in METRICS])
    return means.groupBy("method").agg(*[F.avg(m).alias(m) for m in METRICS]).orderBy(
        F.desc("ndcg"), "method"
    )
