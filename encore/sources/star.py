"""The star-schema test tables seen as playlists.

A customer is a playlist, an order line one of its entries, a part a track, a
brand its artist and a supplier its album. Entries are ordered by order date.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from encore.operators import binning, profile, split
from encore.sources.ordered import ordered
from encore.sources.workspace import spread, stored, workspace

# Fixed values of the test set-up.
ENTRY_ORDER = ["edited_at", "order_id", "line_no", "part_id", "supplier_id", "duration_ms"]
KS = (0, 1, 5, 10, 15, 25)
TEST_SHARE = 0.1
SPLIT_SEED, EVAL_SEED, BUCKET_SEED = 42, 43, 44
SLANG = [("hm", ["homework"]), ("re", ["are", "here"]), ("ou", ["or"])]
EMOJI_TERMS = [("😍", ["love"]), ("th", ["the"])]


def _epoch(stamp: str) -> Column:
    """Epoch seconds of the day of a timestamp without zone."""
    return F.datediff(F.to_date(stamp), F.lit("1970-01-01")).cast("long") * 86400


class Star:
    """Lazily built playlist tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        tag = hashlib.md5(self.folder.encode()).hexdigest()[:12]
        self.path = f"{workspace(spark)}/{tag}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stored(self, name: str, build) -> DataFrame:
        return stored(self.spark, f"{self.path}/{name}", build)

    def _entries(self) -> DataFrame:
        """Entries by numbers, each shuffled once per join and once into order; see ``tracks``."""
        lines = self.table("lineitem").select(
            "l_orderkey",
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_linenumber").alias("line_no"),
            (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"),
        )
        orders = self.table("orders").select(
            F.col("o_custkey").alias("pid"),
            F.col("o_orderkey").alias("order_id"),
            _epoch("o_orderdate").alias("edited_at"),
            (F.col("o_orderstatus") == "F").alias("is_final"),
        )
        parts = self.table("part").select(
            "p_partkey", F.col("p_name").alias("track_name"), F.col("p_brand").alias("artist_uri")
        )
        rows = lines.join(orders, F.col("l_orderkey") == F.col("order_id"))
        return rows.join(parts, F.col("part_id") == F.col("p_partkey")).drop("l_orderkey", "p_partkey")

    @cached_property
    def tracks(self) -> DataFrame:
        """Entries with their position, stored in playlist order."""
        rows = ordered(self.spark, self._entries, "pid", ENTRY_ORDER, f"{self.path}/tracks")
        return rows.select(
            "pid",
            F.col("part_id").cast("string").alias("track_uri"),
            "track_name",
            "artist_uri",
            F.col("supplier_id").cast("string").alias("album_uri"),
            "duration_ms",
            "edited_at",
            "order_id",
            "is_final",
            "pos",
        )

    @cached_property
    def rare_tracks(self) -> DataFrame:
        """The same entries with tracks split in five by supplier: many rare tracks."""
        fifth = (F.col("album_uri").cast("long") % 5).cast("string")
        return self.tracks.withColumn("track_uri", F.concat_ws(":", "track_uri", fifth))

    @cached_property
    def names(self) -> DataFrame:
        """(pid, name): a playlist is titled with the whole name and artist of its first entry."""
        return self.stored("names", self._names)

    def _names(self) -> DataFrame:
        title = F.lower(F.translate(F.concat_ws(" ", "track_name", "artist_uri"), "#", " "))
        return self.tracks.where("pos = 0").select("pid", title.alias("name"))

    @cached_property
    def playlists(self) -> DataFrame:
        """One row of features per playlist with entries."""
        return self.stored("playlists", self._playlists)

    def _playlists(self) -> DataFrame:
        orders = self.tracks.groupBy("pid", "order_id").agg(
            F.max("edited_at").alias("modified_at"),
            F.sum("duration_ms").alias("duration_ms"),
            F.max("is_final").alias("is_final"),
        )
        counts = orders.groupBy("pid").agg(
            F.max("modified_at").alias("modified_at"),
            F.sum("duration_ms").alias("duration_ms"),
            F.count("order_id").alias("num_edits"),
            F.count(F.when(F.col("is_final"), F.col("order_id"))).alias("num_followers"),
        )
        spans = self.tracks.groupBy("pid").agg(
            F.countDistinct("artist_uri").alias("num_artists"), F.countDistinct("album_uri").alias("num_albums")
        )
        by_track = profile.popularity_features(
            self.tracks, profile.popularity(self.tracks), "track_uri", "track"
        )
        by_artist = profile.popularity_features(
            self.tracks, profile.popularity(self.tracks, "artist_uri"), "artist_uri", "artist"
        ).drop("num_tracks")
        first = ["pid", "modified_at", "duration_ms", "num_artists", "num_albums", "num_edits", "num_followers"]
        rows = counts.join(spans, "pid").join(by_track, "pid").join(by_artist, "pid").join(self.names, "pid", "left")
        return rows.select(*first, *[c for c in rows.columns if c not in first])

    @cached_property
    def strata(self) -> DataFrame:
        return self.stored("strata", lambda: binning.stratification_classes(self.playlists))

    @cached_property
    def first_split(self) -> DataFrame:
        """(pid, part): the stratified 10 % test part."""
        classes = [f"{c}_class" for c in binning.STRATA]
        return self.stored(
            "first_split", lambda: split.stratified_split(self.strata, classes, TEST_SHARE, SPLIT_SEED)
        )

    def _parts(self, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
        sized = self.first_split.join(self.playlists.select("pid", "num_tracks"), "pid")
        rows = split.assign(tracks, sized)
        return rows.where("part = 'test'"), rows.where("part = 'train'")

    @cached_property
    def parts(self) -> DataFrame:
        """(pid, part, name, num_tracks): final train, dev and test playlists."""
        return self.stored("parts", self._final_parts)

    def _final_parts(self) -> DataFrame:
        candidates = split.covered_candidates(*self._parts(self.tracks))
        drawn = split.draw_eval(candidates, EVAL_SEED)
        return split.with_part(self.playlists, drawn).join(
            self.playlists.select("pid", "name", "num_tracks"), "pid"
        )

    @cached_property
    def lists(self) -> DataFrame:
        """(pid, part, name, num_tracks, k): the evaluation playlists with their bucket."""
        return self.stored(
            "lists", lambda: split.seed_buckets(self.parts.where("part <> 'train'"), KS, BUCKET_SEED)
        )

    @cached_property
    def part_tracks(self) -> DataFrame:
        """(pid, pos, track_uri, artist_uri, part, k, is_seed): entries with their part."""
        return self.stored("part_tracks", self._part_tracks)

    def _part_tracks(self) -> DataFrame:
        keyed = self.parts.select("pid", "part", "num_tracks").join(
            self.lists.select("pid", "k"), "pid", "left"
        )
        rows = split.assign(self.tracks.select("pid", "pos", "track_uri", "artist_uri"), keyed)
        return split.seed_truth(rows)

    @cached_property
    def train(self) -> DataFrame:
        return self.part_tracks.where("part = 'train'").select("pid", "pos", "track_uri")

    @cached_property
    def train_lists(self) -> DataFrame:
        return self.parts.where("part = 'train'").select("pid", "name", "num_tracks")

    @cached_property
    def test_lists(self) -> DataFrame:
        return self.lists.where("part = 'test'")

    @cached_property
    def seeds(self) -> DataFrame:
        """Visible seeds of the test lists."""
        return self.part_tracks.where("part = 'test' and is_seed").select("pid", "pos", "track_uri")

    @cached_property
    def truth(self) -> DataFrame:
        """Hidden entries of the test lists, counted from 0."""
        rows = self.part_tracks.where("part = 'test' and not is_seed")
        return rows.select("pid", (F.col("pos") - F.col("k")).alias("pos"), "track_uri", "k")

    @cached_property
    def word_vectors(self) -> DataFrame:
        """(token, vec): every title word gets one of the embeddings by its hash."""
        words = self.names.select(F.explode(F.split("name", " ")).alias("token")).where("token <> ''").distinct()
        n = self.table("embeddings").agg(F.count(F.lit(1))).scalar()
        slot = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % n
        vectors = self.table("embeddings").select(
            F.col("vec_id").alias("_slot"), F.col("embedding").cast("array<double>").alias("vec")
        )
        return words.withColumn("_slot", slot).join(vectors, "_slot").select("token", "vec")

    @cached_property
    def item_vectors(self) -> DataFrame:
        """(item, vec, artist): the embeddings as item vectors."""
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("item"),
            F.col("embedding").cast("array<double>").alias("vec"),
            F.concat(F.lit("a"), F.col("label").cast("string")).alias("artist"),
        )

    @cached_property
    def item_seeds(self) -> DataFrame:
        """Test seeds with the track mapped onto an item vector."""
        n = self.table("embeddings").agg(F.count(F.lit(1))).scalar()
        return self.seeds.withColumn("track_uri", (F.col("track_uri").cast("long") % n).cast("string"))

    @cached_property
    def docs(self) -> DataFrame:
        return spread(self.table("documents").select("doc_id", "text"))


_open: dict[tuple[str, str], Star] = {}


def star(spark: SparkSession, folder: str) -> Star:
    """The playlist tables of a folder, shared by all queries of an application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Star(spark, folder)
    return _open[key]
