"""Projections, membership filters and point reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: playlists per slice file.
SLICE = 1000


def explode_tracks(playlists: DataFrame, column: str = "tracks") -> DataFrame:
    """One row per entry of the nested track arrays; empty lists give no rows."""
    return playlists.select("pid", F.inline(column))


def with_slice(df: DataFrame) -> DataFrame:
    """Add the first id of the playlist's slice and its place in the slice."""
    return df.withColumn("slice", F.floor(F.col("pid") / SLICE) * SLICE).withColumn(
        "idx", F.pmod(F.col("pid"), F.lit(SLICE))
    )


def lookup_playlists(tracks: DataFrame, pids: list[int]) -> DataFrame:
    """Entries of single playlists; negative ids find nothing.

    The table is stored in playlist order, so the filter skips all other files
    and row groups by their statistics.
    """
    valid = [p for p in pids if p >= 0]
    return with_slice(tracks.where(F.col("pid").isin(valid)))


def feature_columns(df: DataFrame, drop: tuple[str, ...] = ("tracks", "description")) -> DataFrame:
    """Columns whose name holds none of the given words."""
    return df.select(*[c for c in df.columns if not any(d in c for d in drop)])


def keep_rows(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys, on, "left_semi")


def drop_rows(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys, on, "left_anti")


def duration_columns(df: DataFrame) -> DataFrame:
    """Mean track length, minutes and whole minutes."""
    minutes = F.col("duration_ms") / 60000
    return df.withColumns(
        {
            "ms_mean": F.col("duration_ms") / F.col("num_tracks"),
            "minutes": F.round(minutes, 2),
            "whole_minutes": F.floor(minutes),
        }
    )
