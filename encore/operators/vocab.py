"""Item vocabulary and id encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from encore.operators.profile import popularity
from encore.operators.ranges import range_prefix_sum
from encore.operators.ranking import hash_block, hash_order, split_rank
from encore.operators.skew import salted_join
from encore.sources.workspace import cut

# Reserved tokens and their ids.
EOS, UNK = "<eos>", "<unk>"
EOS_ID, UNK_ID = 0, 1
FIRST_ID = 2


def rank_ids(counts: DataFrame, first_id: int = 0) -> DataFrame:
    """(track_uri, item_id, freq): ids by falling count, ties in a fixed hash order."""
    rows = (
        cut(counts).withColumn("_fall", -F.col("freq"))
        .withColumn("_hash", hash_order("vocab", "track_uri"))
        .withColumn("_hash_block", hash_block(F.col("_hash")))
    )
    ranked = split_rank(rows, ["_hash", "track_uri"], "_rank", [], ["_fall", "_hash_block"])
    return ranked.select("track_uri", (F.col("_rank") - 1 + first_id).alias("item_id"), "freq")


def build_vocab(tracks: DataFrame) -> DataFrame:
    """Vocabulary of all tracks."""
    return rank_ids(popularity(tracks).withColumnRenamed("popularity", "freq"))


def prune_vocab(vocab: DataFrame, keep: DataFrame, min_count: int = 5, lists: DataFrame | None = None) -> DataFrame:
    """Tracks with more than ``min_count`` mentions or in ``keep``, ids from 2.

    ``<eos>`` (id 0) counts one mention per playlist of ``lists``, ``<unk>`` (id 1) none.
    """
    marks = keep.select("track_uri").distinct().withColumn("_keep", F.lit(True))
    kept = vocab.join(marks, "track_uri", "left").where((F.col("freq") > min_count) | F.col("_keep"))
    items = rank_ids(kept.select("track_uri", "freq"), FIRST_ID)
    n = F.lit(0).cast("long")
    if lists is not None:
        n = lists.agg(F.countDistinct("pid")).scalar()
    reserved = vocab.sparkSession.range(2).select(
        F.when(F.col("id") == EOS_ID, EOS).otherwise(UNK).alias("track_uri"),
        F.col("id").alias("item_id"),
        F.when(F.col("id") == EOS_ID, n).otherwise(F.lit(0)).alias("freq"),
    )
    return reserved.unionByName(items)


def encode(tracks: DataFrame, vocab: DataFrame, unknown: str = "drop") -> DataFrame:
    """(pid, pos, item_id); tracks outside the vocabulary are dropped or mapped to ``<unk>``."""
    how = "inner" if unknown == "drop" else "left"
    ids = salted_join(tracks.select("pid", "pos", "track_uri"), vocab, "track_uri", "freq", how=how)
    return ids.select("pid", "pos", F.coalesce("item_id", F.lit(UNK_ID)).alias("item_id"))


def append_eos(tracks: DataFrame) -> DataFrame:
    """Add an ``<eos>`` entry behind every playlist."""
    ends = tracks.groupBy("pid").agg((F.max("pos") + 1).alias("pos"))
    return tracks.select("pid", "pos", "track_uri").unionByName(
        ends.withColumn("track_uri", F.lit(EOS))
    )


def corpus(encoded: DataFrame) -> DataFrame:
    """Add ``offset``: the place of each entry when all playlists are joined in pid order.

    ``pos`` must be dense in each playlist. Playlists are added up in ranges of ids, so
    sparse or hashed ids give ranges of the same size as dense ones.
    """
    sizes = encoded.groupBy("pid").agg(F.count(F.lit(1)).alias("_n"))
    starts = range_prefix_sum(sizes, "_n", ["pid"], "_start")
    return salted_join(encoded, starts.select("pid", "_n", "_start"), "pid", "_n").select(
        "pid", "pos", "item_id", (F.col("_start") + F.col("pos")).alias("offset")
    )


def window_counts(lists: DataFrame, length: int, step: int, batch: int) -> DataFrame:
    """Windows and steps per epoch from playlist lengths (pid, num_tracks).

    The corpus holds one ``<eos>`` per playlist.
    """
    n = F.sum(F.col("num_tracks") + 1)
    inside = F.sum(F.greatest(F.col("num_tracks") - length, F.lit(0)))
    return lists.agg(n.alias("corpus_items"), inside.alias("playlist_windows")).select(
        "corpus_items",
        "playlist_windows",
        F.floor((F.floor(F.col("corpus_items") / batch) - 1) / step).alias("corpus_steps"),
        F.ceil(F.col("playlist_windows") / batch).alias("playlist_steps"),
    )


def batches(windows: DataFrame, size: int, seed: int) -> DataFrame:
    """Give each window (pid, start) its batch number in a fixed shuffled order."""
    rows = cut(windows).withColumn("_hash", hash_order(seed, "pid", "start")).withColumn(
        "_hash_block", hash_block(F.col("_hash"))
    )
    ranked = split_rank(rows, ["_hash", "pid", "start"], "_rank", [], ["_hash_block"])
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size)).drop(
        "_rank", "_hash", "_hash_block"
    )


def decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """(pid, pos, track_uri) from ids."""
    return salted_join(encoded, vocab, "item_id", "freq").select("pid", "pos", "track_uri")
