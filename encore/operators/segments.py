"""Ordered lists cut into arrays of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from encore.operators.ranking import split_rank
from encore.sources.workspace import cut

# Positions per segment. A list of any length becomes arrays of this length.
WIDTH = 1024


def _overlapping(df: DataFrame, index: str, item: str, keys: list[str], overlap: int, width: int) -> DataFrame:
    """Rows (keys, _i, _item, segment); the first ``overlap`` of a segment also stand in the one before."""
    own = F.floor(F.col(index) / width)
    rows = df.select(*keys, F.col(index).alias("_i"), F.col(item).alias("_item"), own.alias("segment"))
    if overlap:
        shared = (F.col("_i") % width < overlap) & (F.col("segment") > 0)
        both = F.array(F.col("segment") - 1, F.col("segment"))
        rows = rows.withColumn("segment", F.explode(F.when(shared, both).otherwise(F.array("segment"))))
    return rows


def segments(
    df: DataFrame,
    index: str,
    item: str,
    keys: list[str] | None = None,
    overlap: int = 0,
    width: int = WIDTH,
) -> DataFrame:
    """Rows (keys, segment, start, items); each array reaches ``overlap`` items
    into the next segment, so that windows which begin in it are whole."""
    keys = keys or []
    width = max(width, overlap)
    rows = _overlapping(df, index, item, keys, overlap, width)
    cells = F.array_sort(F.collect_list(F.struct("_i", "_item")))
    return (
        rows.groupBy(*keys, "segment")
        .agg(cells.alias("_cells"))
        .select(
            *keys,
            "segment",
            (F.col("segment") * width).alias("start"),
            F.transform("_cells", lambda c: c["_item"]).alias("items"),
            F.lit(width).alias("_width"),
        )
    )


def playlist_arrays(tracks: DataFrame) -> DataFrame:
    """Ordered track arrays per playlist segment."""
    return segments(tracks, "pos", "track_uri", ["pid"]).drop("_width")


def _starts(length: int, step: int = 1) -> Column:
    """Offsets inside a segment at which a window plus its next item fits."""
    last = F.least(F.size("items") - length, F.col("_width")) - 1
    first = F.pmod(-F.col("start"), F.lit(step)).cast("int")
    some = F.sequence(first, last.cast("int"), F.lit(step))
    return F.when(first <= last, some).otherwise(F.array().cast("array<int>"))


def _windows(cut: DataFrame, length: int, step: int, keys: list[str]) -> DataFrame:
    return cut.withColumn("_at", F.explode(_starts(length, step))).select(
        *keys,
        (F.col("start") + F.col("_at")).alias("start"),
        F.slice("items", F.col("_at") + 1, length).alias("x"),
        F.slice("items", F.col("_at") + 2, length).alias("y"),
    )


def playlist_windows(
    encoded: DataFrame, length: int, item: str = "item_id", drop_item: int | None = None
) -> DataFrame:
    """All windows inside a playlist, with the sequence one step ahead as label.

    With ``drop_item`` the kept entries count from 0. A list whose places all lie in the first
    segment is dealt out once and its sorted array tells the new places; only longer lists are numbered
    again and cut into segments.
    """
    if drop_item is None:
        return _windows(segments(encoded, "pos", item, ["pid"], length), length, 1, ["pid"])
    kept = encoded.where(F.col(item) != drop_item)
    long = cut(kept.where(~F.col("pos").between(0, WIDTH - 1) & F.col("pid").isNotNull()).select("pid").distinct())
    if long.isEmpty():
        return _windows(_single_segments(kept, item), length, 1, ["pid"])
    short = _single_segments(kept.join(long, "pid", "left_anti"), item)
    dense = dense_positions(kept.join(long, "pid", "left_semi"), item)
    return _windows(short.unionByName(segments(dense, "pos", item, ["pid"], length)), length, 1, ["pid"])


def _single_segments(rows: DataFrame, item: str) -> DataFrame:
    """One array per list of at most a segment, as of :func:`segments` with dense positions."""
    # Dealt out before they are grouped: rows of a list seldom lie together, so a map-side grouping gains nothing.
    dealt = rows.where("pid is not null and pos is not null").select("pid", "pos", item).repartition("pid")
    return (
        dealt.groupBy("pid")
        .agg(F.sort_array(F.collect_list(F.struct("pos", item))).alias("_cells"))
        .select(
            "pid",
            F.lit(0).cast("long").alias("segment"),
            F.lit(0).cast("long").alias("start"),
            F.transform("_cells", lambda c: c[item]).alias("items"),
            F.size("_cells").alias("_width"),
        )
    )


def corpus_windows(corpus: DataFrame, length: int, step: int, item: str = "item_id") -> DataFrame:
    """Windows over the joined corpus, every ``step`` items, across list borders."""
    return _windows(segments(corpus, "offset", item, [], length), length, step, [])


def next_items(tracks: DataFrame, item: str = "track_uri", max_gap: int = 1) -> DataFrame:
    """Pairs (pid, prev, next, gap) of items at most ``max_gap`` places apart.

    A row meets the rows behind it in its sorted segment, so no array of a segment is built.
    """
    width = max(WIDTH, max_gap)
    rows = _overlapping(tracks, "pos", item, ["pid"], max_gap, width)
    order = Window.partitionBy("pid", "segment").orderBy("_i", "_item")
    rows = rows.withColumn("_place", F.row_number().over(order))
    # The place tells an item that is null from the end of the list.
    behind = {f"{c}{gap}": F.lead(c, gap).over(order) for gap in range(1, max_gap + 1) for c in ("_place", "_item")}
    pairs = []
    for gap in range(1, max_gap + 1):
        pair = F.struct(F.col("_item").alias("prev"), F.col(f"_item{gap}").alias("next"), F.lit(gap).alias("gap"))
        pairs.append(F.when(F.col(f"_place{gap}").isNotNull(), pair))
    own = rows.withColumns(behind).where(F.col("_place") <= width)
    return own.select("pid", F.inline(F.array(*pairs))).where("gap is not null")


def dense_positions(rows: DataFrame, item: str) -> DataFrame:
    """Number the kept rows of each playlist again from 0."""
    blocks = rows.withColumn("_mile", F.floor(F.col("pos") / (WIDTH * WIDTH))).withColumn(
        "_segment", F.floor(F.col("pos") / WIDTH)
    )
    ranked = split_rank(blocks, ["pos"], "_pos", ["pid"], ["_mile", "_segment"])
    return ranked.select("pid", (F.col("_pos") - 1).alias("pos"), item)
