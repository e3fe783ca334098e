"""Recommendation files: a header line, then one line per playlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from encore.sources.workspace import is_complete

HEADER = "team_info"


def write_recs(recs: DataFrame, path: str, header: tuple[str, str, str], n: int = 500, append: bool = False) -> None:
    """Write ``pid, uri, uri...`` lines, each followed by a blank one.

    The header (track, team, contact) is a file of its own in the folder; a list
    has at most ``n`` items. With ``append`` the lists join those of a finished write, whose
    header stays the only one; else an older folder is replaced.
    """
    spark = recs.sparkSession
    first = spark.createDataFrame([(",".join([HEADER, *header]),)], "value string")
    cells = F.array_sort(F.collect_list(F.struct("rank", "track_uri")))
    lines = (
        recs.where(F.col("rank") <= n)
        .groupBy("pid")
        .agg(F.transform(cells, lambda c: c["track_uri"]).alias("items"))
        .select(F.concat(F.concat_ws(", ", F.col("pid").cast("string"), "items"), F.lit("\n")).alias("value"))
    )
    if not append or not is_complete(spark, path):
        first.coalesce(1).write.mode("overwrite").text(path)
    lines.write.mode("append").text(path)


def read_recs(spark: SparkSession, path: str) -> DataFrame:
    """(pid, rank, track_uri) of a recommendation file; the last line of a playlist counts."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", place.alias("place"))
    kept = lines.where((F.trim("value") != "") & ~F.col("value").startswith(HEADER))
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    parsed = kept.select(cells[0].cast("long").alias("pid"), F.slice(cells, 2, F.size(cells)).alias("items"), "place")
    last = parsed.groupBy("pid").agg(F.max_by("items", "place").alias("items"))
    return last.select("pid", F.posexplode("items").alias("_at", "track_uri")).select(
        "pid", (F.col("_at") + 1).alias("rank"), "track_uri"
    )


def pending(lists: DataFrame, done: DataFrame) -> DataFrame:
    """Playlists that have no recommendations yet."""
    return lists.join(done.select("pid").distinct(), "pid", "left_anti")
