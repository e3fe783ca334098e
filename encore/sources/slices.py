"""Playlist documents: slice files, challenge sets and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from encore.operators.factorisation import dense_ids
from encore.operators.lookups import with_slice
from encore.operators.segments import WIDTH
from encore.operators.skew import salted_join

_LONG, _TEXT = T.LongType(), T.StringType()

TRACK = T.StructType(
    [T.StructField("pos", _LONG)]
    + [
        T.StructField(c, _TEXT)
        for c in ("track_name", "track_uri", "album_name", "album_uri", "artist_name", "artist_uri")
    ]
    + [T.StructField("duration_ms", _LONG)]
)
PLAYLIST = T.StructType(
    [T.StructField("pid", _LONG), T.StructField("name", _TEXT), T.StructField("description", _TEXT)]
    + [
        T.StructField(c, _LONG)
        for c in (
            "modified_at", "num_artists", "num_albums", "num_tracks", "num_followers", "num_edits", "duration_ms",
        )
    ]
    + [T.StructField("collaborative", _TEXT), T.StructField("tracks", T.ArrayType(TRACK))]
)
INFO = T.StructType([T.StructField(c, _TEXT) for c in ("slice", "version", "generated_on")])
SLICE = T.StructType([T.StructField("info", INFO), T.StructField("playlists", T.ArrayType(PLAYLIST))])


def _typed(playlists: DataFrame) -> DataFrame:
    flag = F.lower("collaborative") == "true"
    return playlists.withColumn("collaborative", flag)


def read_slices(
    spark: SparkSession, path: str, glob: str = "*mpd*.json", lines: bool = False
) -> DataFrame:
    """Playlists of all slice files ``{info, playlists: [...]}`` below a folder.

    The schema is fixed; ``collaborative`` may be a boolean or a text. A file is
    one object, or with ``lines`` one object per line.
    """
    files = spark.read.schema(SLICE).option("pathGlobFilter", glob)
    docs = files.json(path, multiLine=not lines)
    return _typed(docs.select(F.inline("playlists")))


def read_challenge_set(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Playlists of a challenge file; their track lists hold only seeds or nothing."""
    empty = F.array().cast(T.ArrayType(TRACK))
    return read_slices(spark, path, "*.json", lines).withColumn("tracks", F.coalesce("tracks", empty))


def _documents(playlists: DataFrame, tracks: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Playlist documents; a long playlist is cut into parts of at most 1,024 entries."""
    names = [f.name for f in TRACK.fields]
    cells = F.struct(*[
        (F.col(n) if n in tracks.columns else F.lit(None)).cast(TRACK[n].dataType).alias(n) for n in names
    ])
    parts = tracks.groupBy("pid", F.floor(F.col("pos") / WIDTH).alias("part")).agg(
        F.array_sort(F.collect_list(cells)).alias("tracks")
    )
    meta = [f.name for f in PLAYLIST.fields if f.name in playlists.columns]
    how = "right" if keep_empty else "inner"
    return salted_join(parts, playlists.select(*meta), "pid", how=how)


def _info(number: Column) -> Column:
    return F.struct(
        number.cast("string").alias("slice"),
        F.lit("v1").alias("version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("generated_on"),
    )


def write_slices(playlists: DataFrame, tracks: DataFrame, path: str, keep_empty: bool = False) -> None:
    """Write ``{info, playlists}`` objects, one per line.

    An object holds one playlist part, so that no task gathers a whole slice.
    """
    docs = with_slice(_documents(playlists, tracks, keep_empty))
    fields = [c for c in docs.columns if c not in ("part", "slice", "idx")]
    rows = docs.select(_info(F.col("slice")).alias("info"), F.array(F.struct(*fields)).alias("playlists"))
    rows.write.mode("overwrite").json(path)


def extract_sample(playlists: DataFrame, tracks: DataFrame, pids: DataFrame, chunk: int = 1000) -> DataFrame:
    """(slice, info, pid, ..., tracks): documents of the listed playlists in chunks."""
    numbered = dense_ids(pids.select("pid").distinct(), "pid", "sample")
    chosen = playlists.join(numbered, "pid")
    docs = _documents(chosen, salted_join(tracks, numbered, "pid").drop("sample"))
    with_number = docs.join(numbered, "pid")
    number = F.floor(F.col("sample") / chunk)
    return with_number.withColumn("slice", number).withColumn("info", _info(number)).drop("sample")


def write_sample(sample: DataFrame, path: str) -> None:
    """One folder of JSON lines per chunk; the parts of a long playlist stay apart."""
    sample.repartition("slice", "part").write.mode("overwrite").partitionBy("slice").json(path)


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """Playlist documents of a written sample with their chunk number."""
    schema = T.StructType([*PLAYLIST.fields, T.StructField("info", INFO), T.StructField("part", _LONG)])
    return _typed(spark.read.schema(schema).json(path))
