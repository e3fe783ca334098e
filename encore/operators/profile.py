"""Popularity, distributions and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from encore.functions.significance import correlation_p_value
from encore.operators.quantiles import quantile_row
from encore.operators.skew import salted_join


def popularity(tracks: DataFrame, key: str = "track_uri") -> DataFrame:
    """Mentions of each key; the same track counts again if listed twice."""
    return tracks.groupBy(key).agg(F.count(F.lit(1)).alias("popularity"))


def popularity_features(tracks: DataFrame, counts: DataFrame, key: str, prefix: str) -> DataFrame:
    """Sum, mean and median of the popularity of a playlist's entries.

    Entries meet the counts as they are and are then added up per playlist, so each is
    shuffled once for the join and once for the sums. The median counts distinct values.
    """
    entries = salted_join(tracks.select("pid", key), counts, key, "popularity")
    return entries.groupBy("pid").agg(
        F.sum("popularity").alias(f"{prefix}_popularity_sum"),
        (F.sum("popularity") / F.count(F.lit(1))).alias(f"{prefix}_popularity_mean"),
        F.percentile("popularity", 0.5).alias(f"{prefix}_popularity_median"),
        F.count(F.lit(1)).alias("num_tracks"),
    )


def first_wins(tracks: DataFrame, key: str, columns: list[str], last: bool = False) -> DataFrame:
    """One row per key: its columns at the first (or last) mention."""
    place = F.struct("pid", "pos")
    pick = F.max_by if last else F.min_by
    return tracks.groupBy(key).agg(pick(F.struct(*columns), place).alias("_row")).select(
        key, *[F.col("_row")[c].alias(c) for c in columns]
    )


def threshold_shares(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Rows that meet each predicate and their share, in one pass."""
    cells = [F.count(F.lit(1)).alias("_n")]
    cells += [F.count_if(p).alias(name) for name, p in predicates.items()]
    rows = [
        F.struct(F.lit(name).alias("predicate"), F.col(name).alias("n"), (F.col(name) / F.col("_n")).alias("share"))
        for name in predicates
    ]
    return df.agg(*cells).select(F.inline(F.array(*rows)))


def extreme_rows(df: DataFrame, column: str, largest: bool = True) -> DataFrame:
    """Rows at the largest (smallest) value of a column."""
    edge = df.agg((F.max if largest else F.min)(column)).scalar()
    return df.where(F.col(column) == edge)


def describe(df: DataFrame, column: str) -> DataFrame:
    """Mean, sample deviation, extremes and quartiles, one row."""
    names = ["p25", "p50", "p75"]
    quartiles = quantile_row(df, column, [0.25, 0.5, 0.75], names).select(F.struct(*names)).scalar()
    x = F.col(column).cast("double")
    return (
        df.agg(
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        )
        .withColumn("_q", quartiles)
        .select("mean", "std", "min", *[F.col("_q")[n].alias(n) for n in names], "max")
    )


def describe_rows(df: DataFrame, column: str) -> DataFrame:
    """:func:`describe` as rows (stat, value)."""
    stats = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    cells = [F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in stats]
    return describe(df, column).select(F.inline(F.array(*cells)))


def describe_delta(train: DataFrame, dev: DataFrame, column: str) -> DataFrame:
    """Statistics of two parts side by side with difference and percent."""
    left = describe_rows(train, column).withColumnRenamed("value", "train")
    right = describe_rows(dev, column).withColumnRenamed("value", "dev")
    delta = F.col("train") - F.col("dev")
    return left.join(right, "stat").select(
        "stat", "train", "dev", delta.alias("delta"),
        (delta / F.nullif(F.col("dev"), F.lit(0.0)) * 100).alias("delta_ratio_percent"),
    )


def length_profile(df: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation, median, longest and shortest text length."""
    lengths = df.select(F.length(column).alias("length"))
    median = quantile_row(lengths, "length", [0.5], ["p50"]).scalar()
    return lengths.agg(
        F.avg("length").alias("mean"),
        F.stddev_pop("length").alias("std"),
        F.max("length").alias("max"),
        F.min("length").alias("min"),
    ).withColumn("median", median)


def long_tail(df: DataFrame, column: str, cutoff: int = 10) -> DataFrame:
    """Rows whose value is exactly 1..cutoff, and above; empty buckets show 0."""
    spark = df.sparkSession
    spine = spark.range(1, cutoff + 2).select(F.col("id").alias("bucket"))
    counts = (
        df.where(F.col(column) >= 1)
        .groupBy(F.least(F.col(column), F.lit(cutoff + 1)).cast("long").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = df.agg(F.count(column)).scalar()
    return spine.join(counts, "bucket", "left").select(
        F.when(F.col("bucket") > cutoff, F.lit(f">{cutoff}")).otherwise(F.col("bucket").cast("string")).alias("bucket"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / total).alias("share"),
    )


def top_share(df: DataFrame, column: str, k: int) -> DataFrame:
    """Share of a column's total that the ``k`` largest rows hold."""
    total = df.agg(F.sum(column)).scalar()
    top = df.select(column).orderBy(F.desc(column)).limit(k)
    return top.agg(F.sum(column).alias("top"), F.count(F.lit(1)).alias("rows")).withColumn(
        "share", F.col("top") / total
    )


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width counts (bin, low, high, n); the last bin holds its upper end."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("low"), F.max(x).alias("high"))
    if low is not None:
        ends = ends.select(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    ends = ends.select(F.struct("low", "high")).scalar()
    rows = df.select(x.alias("x"), ends.alias("e")).where("x between e.low and e.high")
    width = (F.col("e.high") - F.col("e.low")) / bins
    place = F.when(width > 0, F.floor((F.col("x") - F.col("e.low")) / width)).otherwise(F.lit(0))
    counts = rows.groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin"), ends.alias("e"))
    return spine.join(counts, "bin", "left").select(
        "bin",
        (F.col("e.low") + F.col("bin") * width).alias("low"),
        (F.col("e.low") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def name_collisions(tracks: DataFrame, given: DataFrame, uri: str = "artist_uri", name: str = "artist_name") -> DataFrame:
    """Mentions per artist name over all its URIs, against a given table (name, given)."""
    by_uri = tracks.groupBy(name, uri).agg(F.count(F.lit(1)).alias("n"))
    by_name = by_uri.groupBy(name).agg(
        F.sum("n").alias("popularity"), F.count(F.lit(1)).alias("uris"), F.max("n").alias("largest")
    )
    return by_name.join(given, name, "left").withColumn("delta", F.col("popularity") - F.col("given"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation r, row count, t statistic and two-sided p-value."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = df.where(x.isNotNull() & y.isNotNull())
    one = both.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    return one.withColumn(
        "t", F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    ).withColumn("p", correlation_p_value(F.col("r"), F.col("n")))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairwise correlations as rows (a, b, r), computed in one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = [
        F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
        for p, q in ((a, b), (b, a))
    ]
    cells += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")) for c in columns]
    return one.select(F.inline(F.array(*cells)))


def top_artists_in_top_tracks(tracks: DataFrame, k: int = 20) -> DataFrame:
    """Artists with more than one track among the ``k`` most popular ones."""
    counts = tracks.groupBy("track_uri").agg(
        F.count(F.lit(1)).alias("popularity"),
        F.min_by("artist_uri", F.struct("pid", "pos")).alias("artist_uri"),
    )
    top = counts.orderBy(F.desc("popularity"), "track_uri").limit(k)
    return top.groupBy("artist_uri").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def shape(df: DataFrame, column: str) -> DataFrame:
    """Population skewness and interquartile range."""
    q = quantile_row(df, column, [0.25, 0.75], ["p25", "p75"]).select(F.struct("p25", "p75")).scalar()
    return (
        df.agg(F.skewness(F.col(column).cast("double")).alias("skewness"))
        .withColumn("_q", q)
        .select("skewness", (F.col("_q.p75") - F.col("_q.p25")).alias("iqr"))
    )


def bucket_means(metrics: DataFrame, bucket: str, columns: list[str]) -> DataFrame:
    """Mean per bucket, and as ``avg`` the mean of the bucket means."""
    means = metrics.groupBy(bucket).agg(
        *[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n")
    )
    overall = means.agg(*[F.avg(c).alias(c) for c in columns], F.sum("n").alias("n"))
    return means.withColumn(bucket, F.col(bucket).cast("string")).unionByName(
        overall.withColumn(bucket, F.lit("avg"))
    )
