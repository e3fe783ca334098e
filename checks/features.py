"""Playlist model, projections, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from encore.functions.titles import epoch_day, hours_label
from encore.functions.significance import correlation_p_value
from encore.operators import binning, lookups, profile, ranking, segments, sketches
from encore.operators.skew import salted_join
from encore.operators.split import split_report

FEATURES = ["num_tracks", "modified_at", "track_popularity_median", "num_artists", "duration_ms"]


@query("a2_explode_tracks", "SELECT pid, pos, track_uri, artist_uri, album_uri, duration_ms FROM e_tracks")
def _(s):
    arrays = s.tracks.groupBy("pid", F.floor(F.col("pos") / segments.WIDTH).alias("segment")).agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "track_uri", "artist_uri", "album_uri", "duration_ms"))
        ).alias("tracks")
    )
    return lookups.explode_tracks(arrays)


@query(
    "a3_collect_playlists",
    "SELECT pid, pos // 1024 AS segment, min(pos) AS start, string_agg(track_uri, ' ' ORDER BY pos) AS tracks "
    "FROM e_tracks GROUP BY ALL",
)
def _(s):
    return segments.playlist_arrays(s.tracks).select(
        "pid", "segment", "start", F.array_join("items", " ").alias("tracks")
    )


@query(
    "a4_lookup_playlist",
    "SELECT pid, pid // 1000 * 1000 AS slice, pid % 1000 AS idx, pos, track_uri FROM e_tracks WHERE pid IN (9, 77, 145)",
)
def _(s):
    return lookups.lookup_playlists(s.tracks, [9, 77, 145, 1_000_000, -1]).select(
        "pid", "slice", "idx", "pos", "track_uri"
    )


@query("b1_feature_projection", "SELECT pid, num_tracks, num_artists, num_albums, num_edits, num_followers, duration_ms FROM plist")
def _(s):
    return lookups.feature_columns(s.playlists, drop=("popularity", "name", "modified"))


@query(
    "b2_membership_filter",
    "SELECT count(*) FILTER (WHERE part = 'test') AS inside, count(*) FILTER (WHERE part = 'train') AS outside "
    "FROM first_split",
)
def _(s):
    picked = s.first_split.where("part = 'test'").select("pid")
    inside = lookups.keep_rows(s.playlists, picked, "pid").select(F.lit(1).alias("i"))
    outside = lookups.drop_rows(s.playlists, picked, "pid").select(F.lit(0).alias("i"))
    return inside.unionByName(outside).agg(
        F.count_if(F.col("i") == 1).alias("inside"), F.count_if(F.col("i") == 0).alias("outside")
    )


@query("b3_not_null", "SELECT count(*) AS n FROM customer JOIN names ON pid = c_custkey WHERE nullif(name, '') IS NOT NULL")
def _(s):
    return s.names.where(F.nullif(F.col("name"), F.lit("")).isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b4_threshold_shares",
    """SELECT predicate, count(*) FILTER (WHERE hit) AS n, round(count(*) FILTER (WHERE hit) / count(*), 6) AS share FROM (
       SELECT unnest(['few', 'many', 'medium', 'long_title']) AS predicate, unnest([num_followers < 2,
         num_followers > 5, duration_ms / num_tracks BETWEEN 24000 AND 26000, length(name) > 20]) AS hit FROM plist)
       GROUP BY predicate""",
)
def _(s):
    mean = F.col("duration_ms") / F.col("num_tracks")
    rows = profile.threshold_shares(
        s.playlists,
        {
            "few": F.col("num_followers") < 2,
            "many": F.col("num_followers") > 5,
            "medium": mean.between(24000, 26000),
            "long_title": F.length("name") > 20,
        },
    )
    return rounded(rows, "share")


@query(
    "b5_extreme_rows",
    """SELECT 'longest' AS side, pid, duration_ms FROM plist WHERE duration_ms = (SELECT max(duration_ms) FROM plist)
       UNION ALL SELECT 'shortest', pid, duration_ms FROM plist WHERE duration_ms = (SELECT min(duration_ms) FROM plist)""",
)
def _(s):
    cells = ["pid", "duration_ms"]
    top = profile.extreme_rows(s.playlists, "duration_ms").select(F.lit("longest").alias("side"), *cells)
    low = profile.extreme_rows(s.playlists, "duration_ms", False).select(F.lit("shortest").alias("side"), *cells)
    return top.unionByName(low)


@query("b6_contains", "SELECT count(*) AS n FROM plist WHERE contains(name, 'and')")
def _(s):
    return s.playlists.where(F.col("name").contains("and")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b7_derived_columns",
    """SELECT pid, round(duration_ms / num_tracks, 6) AS ms_mean, round(duration_ms / 60000, 2) AS minutes,
       CAST(floor(duration_ms / 60000) AS BIGINT) AS whole_minutes FROM plist""",
)
def _(s):
    return rounded(lookups.duration_columns(s.playlists), "ms_mean").select(
        "pid", "ms_mean", "minutes", "whole_minutes"
    )


@query(
    "b8_hours_label",
    """SELECT pid, pos, (duration_ms * 60 // 60000 // 60) || 'h ' || (duration_ms * 60 // 60000 % 60) || 'm' AS label
       FROM e_tracks""",
)
def _(s):
    return s.tracks.select("pid", "pos", hours_label(F.col("duration_ms") * 60).alias("label"))


@query("b9_epoch_day", "SELECT pid, CAST(CAST(to_timestamp(modified_at) AS DATE) AS VARCHAR) AS day FROM plist")
def _(s):
    return s.playlists.select("pid", epoch_day(F.col("modified_at")).cast("string").alias("day"))


@query("c1_popularity_lookup", "SELECT pid, pos, track_uri, popularity FROM e_tracks JOIN pop USING (track_uri)")
def _(s):
    return salted_join(
        s.tracks.select("pid", "pos", "track_uri"), profile.popularity(s.tracks), "track_uri", "popularity"
    )


@query(
    "c2_dimension_join",
    """SELECT track_uri, n, f.artist_uri, f.track_name FROM (
         SELECT track_uri, count(*) AS n FROM e_tracks GROUP BY track_uri ORDER BY n DESC, track_uri LIMIT 50) t
       LEFT JOIN (SELECT DISTINCT track_uri, artist_uri, track_name FROM e_tracks) f USING (track_uri)""",
)
def _(s):
    top = ranking.top_k(
        s.tracks.groupBy("track_uri").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), "track_uri"], 50
    )
    names = profile.first_wins(s.tracks, "track_uri", ["artist_uri", "track_name"])
    return top.join(names, "track_uri", "left")


@query("c3_semi_anti_join", "SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(s):
    lines = s.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookups.drop_rows(s.table("orders"), lines, "o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("d1_popularity", "SELECT track_uri, popularity FROM pop")
def _(s):
    return profile.popularity(s.tracks)


@query("d1_popularity_artist", "SELECT artist_uri, popularity FROM apop")
def _(s):
    return profile.popularity(s.tracks, "artist_uri")


@query("d2_top_k", "SELECT track_uri, popularity FROM pop ORDER BY popularity DESC, track_uri LIMIT 20")
def _(s):
    return ranking.top_k(profile.popularity(s.tracks), [F.desc("popularity"), "track_uri"], 20)


@query(
    "d3_first_wins",
    """SELECT artist_uri, track_uri, album_uri FROM (SELECT *, row_number() OVER (
       PARTITION BY artist_uri ORDER BY pid, pos) AS r FROM e_tracks) WHERE r = 1""",
)
def _(s):
    return profile.first_wins(s.tracks, "artist_uri", ["track_uri", "album_uri"])


@query(
    "d3_last_wins",
    """SELECT artist_uri, track_uri, album_uri FROM (SELECT *, row_number() OVER (
       PARTITION BY artist_uri ORDER BY pid DESC, pos DESC) AS r FROM e_tracks) WHERE r = 1""",
)
def _(s):
    return profile.first_wins(s.tracks, "artist_uri", ["track_uri", "album_uri"], last=True)


def _popularity_sql(prefix):
    return (
        f"SELECT pid, {prefix}_popularity_sum, round({prefix}_popularity_mean, 6) AS {prefix}_popularity_mean, "
        f"round({prefix}_popularity_median, 6) AS {prefix}_popularity_median, num_tracks FROM {prefix}_feats"
    )


@query("d4_playlist_popularity", _popularity_sql("track"))
def _(s):
    rows = profile.popularity_features(s.tracks, profile.popularity(s.tracks), "track_uri", "track")
    return rounded(rows, "track_popularity_mean", "track_popularity_median")


@query("d4_playlist_popularity_artist", _popularity_sql("artist"))
def _(s):
    counts = profile.popularity(s.tracks, "artist_uri")
    rows = profile.popularity_features(s.tracks, counts, "artist_uri", "artist")
    return rounded(rows, "artist_popularity_mean", "artist_popularity_median")


@query("d5_track_count", "SELECT pid, count(*) AS num_tracks FROM e_tracks GROUP BY pid")
def _(s):
    return s.tracks.groupBy("pid").agg(F.count(F.lit(1)).alias("num_tracks"))


@query(
    "d6_distinct_counts",
    """SELECT count(DISTINCT track_uri) AS tracks, count(DISTINCT artist_uri) AS artists,
       count(DISTINCT track_name) AS names FROM e_tracks""",
)
def _(s):
    return s.tracks.agg(
        F.countDistinct("track_uri").alias("tracks"),
        F.countDistinct("artist_uri").alias("artists"),
        F.countDistinct("track_name").alias("names"),
    )


@query(
    "d6_distinct_counts_sketched",
    """SELECT count(DISTINCT track_uri) AS tracks, count(DISTINCT artist_uri) AS artists,
       count(DISTINCT track_name) AS names, true AS within FROM e_tracks""",
)
def _(s):
    """Exact counts, and whether those of stored sketches of 16 parts lie within their error."""
    columns, error = ["track_uri", "artist_uri", "track_name"], 0.02
    parted = s.tracks.select(*columns, F.pmod(F.xxhash64("pid"), F.lit(16)).alias("part"))
    parts = s.stored("distinct_sketches", lambda: sketches.distinct_sketches(parted, columns, ["part"], error))
    merged = sketches.merged_distinct(parts, columns)
    exact = s.tracks.agg(*[F.countDistinct(c).alias(n) for c, n in zip(columns, ("tracks", "artists", "names"))])
    within = F.lit(True)
    for c, n in zip(columns, ("tracks", "artists", "names")):
        within = within & (F.abs(merged.select(c).scalar() - F.col(n)) <= error * F.col(n) + 1)
    return exact.withColumn("within", within)


def _describe_sql(column, source="plist", where="true"):
    x = f"CAST({column} AS DOUBLE)"
    stats = {
        "mean": f"avg({x})", "std": f"stddev_samp({x})", "min": f"min({x})",
        "p25": f"quantile_cont({x}, 0.25)", "p50": f"quantile_cont({x}, 0.5)",
        "p75": f"quantile_cont({x}, 0.75)", "max": f"max({x})",
    }
    return stats, source, where


def _describe_row(column):
    stats, source, where = _describe_sql(column)
    cells = ", ".join(f"round({v}, 6) AS \"{k}\"" for k, v in stats.items())
    return f"SELECT '{column}' AS feature, {cells} FROM {source}"


@query("d7_describe", " UNION ALL ".join(_describe_row(c) for c in ["num_followers", *FEATURES]))
def _(s):
    parts = [
        profile.describe(s.playlists, c).withColumn("feature", F.lit(c)) for c in ["num_followers", *FEATURES]
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rounded(rows, "mean", "std", "min", "p25", "p50", "p75", "max")


@query(
    "d8_length_profile",
    """SELECT round(avg(length(name)), 6) AS mean, round(stddev_pop(length(name)), 6) AS std,
       CAST(max(length(name)) AS INTEGER) AS max, CAST(min(length(name)) AS INTEGER) AS min,
       round(median(CAST(length(name) AS DOUBLE)), 6) AS median FROM names""",
)
def _(s):
    return rounded(profile.length_profile(s.names, "name"), "mean", "std", "median")


@query(
    "d9_long_tail",
    """SELECT bucket, n, round(n / (SELECT count(*) FROM pop), 6) AS share FROM (
         SELECT CASE WHEN i > 25 THEN '>25' ELSE CAST(i AS VARCHAR) END AS bucket,
           (SELECT count(*) FROM pop WHERE least(popularity, 26) = i) AS n FROM range(1, 27) t(i))""",
)
def _(s):
    return rounded(profile.long_tail(profile.popularity(s.tracks), "popularity", 25), "share")


@query(
    "d10_top_share",
    """SELECT CAST(sum(popularity) FILTER (WHERE r <= 100) AS BIGINT) AS top, 100 AS rows,
       round(sum(popularity) FILTER (WHERE r <= 100) / sum(popularity), 6) AS share
       FROM (SELECT popularity, row_number() OVER (ORDER BY popularity DESC) AS r FROM pop)""",
)
def _(s):
    return rounded(profile.top_share(profile.popularity(s.tracks), "popularity", 100), "share")


@query(
    "d11_histogram",
    """SELECT b AS bin, round(lo + b * (hi - lo) / 21, 6) AS low, round(lo + (b + 1) * (hi - lo) / 21, 6) AS high,
         (SELECT count(*) FROM plist WHERE least(floor((num_tracks - lo) / ((hi - lo) / 21)), 20) = b) AS n
       FROM range(21) t(b), (SELECT CAST(min(num_tracks) AS DOUBLE) AS lo, CAST(max(num_tracks) AS DOUBLE) AS hi FROM plist)""",
)
def _(s):
    return rounded(profile.histogram(s.playlists, "num_tracks", 21), "low", "high")


@query(
    "d12_category_count",
    "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderstatus",
)
def _(s):
    return s.table("orders").groupBy("o_orderstatus").count()


@query(
    "d13_name_collisions",
    """SELECT track_name, CAST(sum(n) AS BIGINT) AS popularity, count(*) AS uris, max(n) AS largest,
         coalesce(max(given), 0) AS given, coalesce(CAST(sum(n) - max(given) AS BIGINT), 0) AS delta
       FROM (SELECT track_name, track_uri, count(*) AS n FROM e_tracks GROUP BY ALL)
       LEFT JOIN (SELECT p_name AS track_name, 30 * count(*) AS given FROM part WHERE p_name LIKE 'b%' GROUP BY p_name)
       USING (track_name) GROUP BY track_name""",
)
def _(s):
    given = (
        s.table("part").where("p_name like 'b%'").groupBy(F.col("p_name").alias("track_name"))
        .agg((30 * F.count(F.lit(1))).alias("given"))
    )
    return profile.name_collisions(s.tracks, given, "track_uri", "track_name").fillna(0)


# The share of the integral of cos(x)^(n - 3) over a quarter turn that lies above asin(|r|), by Simpson's rule.
_SIMPSON = """(SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * pow(cos({0} + (pi() / 2 - {0}) * i / 4000), n - 3)) * (pi() / 2 - {0}) FROM range(4001) t(i))"""
_P = f"{_SIMPSON.format('asin(abs(r))')} / {_SIMPSON.format('0')}"


@query(
    "d14_pearson",
    f"""SELECT round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t, round({_P}, 6) AS p FROM (
       SELECT corr(num_tracks, duration_ms) AS r, count(*) AS n FROM plist)""",
)
def _(s):
    return rounded(profile.pearson(s.playlists, "num_tracks", "duration_ms"), "r", "t", "p")


@query(
    "d14_correlations_by_market",
    f"""SELECT market, round(r, 6) AS r, n, round({_P}, 6) AS p FROM (
       SELECT c_mktsegment AS market, corr(c_acctbal, c_custkey) AS r, count(*) AS n FROM customer GROUP BY c_mktsegment)""",
)
def _(s):
    by = s.table("customer").groupBy(F.col("c_mktsegment").alias("market")).agg(
        F.corr(F.col("c_acctbal").cast("double"), F.col("c_custkey").cast("double")).alias("r"), F.count(F.lit(1)).alias("n")
    )
    return rounded(by.withColumn("p", correlation_p_value(F.col("r"), F.col("n"))), "r", "p")


def _corr_sql():
    rows = [
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM plist" for a in FEATURES for b in FEATURES
    ]
    return " UNION ALL ".join(rows)


@query("d15_correlation_matrix", _corr_sql())
def _(s):
    return rounded(profile.correlation_matrix(s.playlists, FEATURES), "r")


@query(
    "d16_top_artists_in_top_tracks",
    """SELECT artist_uri, count(*) AS n FROM (SELECT track_uri, any_value(artist_uri) AS artist_uri, count(*) AS c
       FROM e_tracks GROUP BY track_uri ORDER BY c DESC, track_uri LIMIT 20) GROUP BY artist_uri HAVING count(*) > 1""",
)
def _(s):
    return profile.top_artists_in_top_tracks(s.tracks)


def _delta_sql(columns):
    parts = []
    for column in columns:
        stats, _, _ = _describe_sql(column)
        for stat, value in stats.items():
            parts.append(
                f"SELECT '{column}' AS feature, '{stat}' AS stat, "
                f"(SELECT {value} FROM plist JOIN parts USING (pid) WHERE part = 'train') AS train, "
                f"(SELECT {value} FROM plist JOIN parts USING (pid) WHERE part = 'dev') AS dev"
            )
    sql = " UNION ALL ".join(parts).replace("CAST(num_tracks AS", "CAST(plist.num_tracks AS")
    return (
        "SELECT feature, stat, round(train, 6) AS train, round(dev, 6) AS dev, round(train - dev, 6) AS delta, "
        f"round((train - dev) / nullif(dev, 0) * 100, 6) AS delta_ratio_percent FROM ({sql})"
    )


def _sides(s):
    rows = s.playlists.join(s.parts.select("pid", "part"), "pid")
    return rows.where("part = 'train'"), rows.where("part = 'dev'")


@query("d17_describe_delta", _delta_sql(["num_artists"]))
def _(s):
    rows = profile.describe_delta(*_sides(s), "num_artists").withColumn("feature", F.lit("num_artists"))
    return rounded(rows, "train", "dev", "delta", "delta_ratio_percent")


@query("f16_split_report", _delta_sql(binning.STRATA))
def _(s):
    return rounded(split_report(*_sides(s), binning.STRATA), "train", "dev", "delta", "delta_ratio_percent")


G1 = (
    "(avg(power(x, 3)) - 3 * avg(x) * avg(power(x, 2)) + 2 * power(avg(x), 3)) / power(var_pop(x), 1.5)"
)


@query(
    "d18_shape",
    f"""SELECT round({G1}, 6) AS skewness, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr
        FROM (SELECT CAST(num_tracks AS DOUBLE) AS x FROM plist)""",
)
def _(s):
    return rounded(profile.shape(s.playlists, "num_tracks"), "skewness", "iqr")


_NATION_MEANS = (
    "SELECT CAST(c_nationkey AS VARCHAR) AS bucket, avg(num_tracks) AS num_tracks, count(*) AS n "
    "FROM plist JOIN customer ON pid = c_custkey GROUP BY ALL"
)


@query(
    "d20_bucket_means",
    f"SELECT bucket, round(num_tracks, 6) AS num_tracks, n FROM ({_NATION_MEANS}) UNION ALL "
    f"SELECT 'avg', round(avg(num_tracks), 6), CAST(sum(n) AS BIGINT) FROM ({_NATION_MEANS})",
)
def _(s):
    nation = s.table("customer").select(F.col("c_custkey").alias("pid"), F.col("c_nationkey").alias("bucket"))
    rows = s.playlists.join(nation, "pid")
    return rounded(profile.bucket_means(rows, "bucket", ["num_tracks"]), "num_tracks")
