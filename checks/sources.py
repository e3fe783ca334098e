"""Readers and writers, tried on data derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.evaluation import full_recs
from checks.registry import query, rounded
from encore.operators import lookups, split
from encore.sources import recfiles, slices, tables


@query(
    "a1_read_slices",
    "SELECT pid, num_tracks, duration_ms FROM plist",
)
def _(s):
    path = f"{s.path}/slices"
    slices.write_slices(s.playlists, s.tracks, path)
    docs = slices.read_slices(s.spark, path, "*.json", lines=True)
    rows = docs.select("pid", F.size("tracks").alias("n"), F.expr("aggregate(tracks, 0L, (t, x) -> t + x.duration_ms)").alias("d"))
    return rows.groupBy("pid").agg(F.sum("n").alias("num_tracks"), F.sum("d").alias("duration_ms"))


@query("a5_a6_rec_file", "SELECT pid, rank, track_uri FROM full_recs")
def _(s):
    path = f"{s.path}/rec_file"
    recfiles.write_recs(full_recs(s), path, ("main", "team", "mail@example.com"))
    return recfiles.read_recs(s.spark, path)


@query("a7_resumed_file", "SELECT pid, rank, track_uri FROM full_recs")
def _(s):
    path, header = f"{s.path}/recs_resumed", ("main", "team", "mail@example.com")
    recs = full_recs(s)
    recfiles.write_recs(recs.where("pid % 2 = 0"), path, header, append=False)
    left = recfiles.pending(recs.select("pid").distinct(), recfiles.read_recs(s.spark, path))
    recfiles.write_recs(lookups.keep_rows(recs, left, "pid"), path, header, append=True)
    return recfiles.read_recs(s.spark, path)


@query("a7_pending_from_file", "SELECT pid FROM test_lists WHERE pid NOT IN (SELECT pid FROM full_recs)")
def _(s):
    path = f"{s.path}/rec_file_done"
    recfiles.write_recs(full_recs(s), path, ("main", "team", "mail@example.com"))
    return recfiles.pending(s.test_lists.select("pid"), recfiles.read_recs(s.spark, path))


@query("a8_features_table", "SELECT pid, num_tracks, round(track_popularity_mean, 6) AS track_popularity_mean FROM plist")
def _(s):
    path = f"{s.path}/features_csv"
    tables.write_features(s.playlists, path)
    rows = tables.read_features(s.spark, path, s.playlists.schema)
    return rounded(rows.select("pid", "num_tracks", "track_popularity_mean"), "track_popularity_mean")


@query("a9_interactions_table", "SELECT pid AS user, CAST(track_uri AS BIGINT) AS item, count(*) AS n FROM train_tracks GROUP BY ALL")
def _(s):
    path = f"{s.path}/interactions_tsv"
    rows = s.train.select(
        F.col("pid").cast("int").alias("user"), F.col("track_uri").cast("int").alias("item"), F.lit(1.0).cast("float").alias("rating")
    )
    tables.write_interactions(rows, path)
    back = tables.read_interactions(s.spark, path)
    return back.groupBy(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("a10_stored_table", "SELECT artist_uri, popularity FROM apop")
def _(s):
    return s.stored("a10", lambda: s.tracks.groupBy("artist_uri").agg(F.count(F.lit(1)).alias("popularity")))


@query(
    "a11_extract_sample",
    """SELECT p.pid, (row_number() OVER (ORDER BY md5('sample:' || pid), pid) - 1) // 100 AS slice, p.num_tracks
       FROM plist p WHERE pid IN (SELECT pid FROM cover)""",
)
def _(s):
    wanted = split.eval_tracks(s.part_tracks.where("part <> 'train'"))
    cover = split.covering_sample(s.train, wanted, 0.0, 7).select("pid")
    path = f"{s.path}/sample"
    slices.write_sample(slices.extract_sample(s.playlists, s.tracks, cover, 100), path)
    back = slices.read_sample(s.spark, path)
    return back.groupBy("pid", F.col("slice").cast("long").alias("slice")).agg(F.sum(F.size("tracks")).alias("num_tracks"))


@query("a12_read_word_vectors", "SELECT token, len(vec) AS size FROM word_vectors")
def _(s):
    path = f"{s.path}/word_vectors_text"
    tables.write_word_vectors(s.word_vectors, path)
    return tables.read_word_vectors(s.spark, path).select("token", F.size("vec").cast("long").alias("size"))


@query("a13_read_replacement_dict", "SELECT r_name AS key, lower(r_name) AS words FROM region")
def _(s):
    path = f"{s.path}/terms"
    rows = s.table("region").select(F.col("r_name").alias("key"), F.split(F.lower("r_name"), " ").alias("tokens"))
    rows.write.mode("overwrite").json(path)
    terms = tables.read_replacement_dict(s.spark, path)
    return s.spark.createDataFrame([(k, " ".join(v)) for k, v in terms], "key string, words string")


@query("a14_read_challenge_set", "SELECT pid, k, count(track_uri) AS seeds FROM test_lists LEFT JOIN seeds USING (pid) GROUP BY ALL")
def _(s):
    path = f"{s.path}/challenge"
    slices.write_slices(s.test_lists, s.seeds, path, keep_empty=True)
    docs = slices.read_challenge_set(s.spark, path, lines=True)
    sizes = docs.groupBy("pid").agg(F.sum(F.size("tracks")).alias("seeds"))
    return lookups.keep_rows(s.test_lists.select("pid", "k"), sizes, "pid").join(sizes, "pid")
