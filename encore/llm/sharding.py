"""Sharding: rendezvous hashing of stable record keys over weighted shards, in column expressions only."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from encore.sources.workspace import cut

# Bits of a hash that become a number between 0 and 1; a double holds them all.
BITS = 53


def even_weights(shards: int) -> dict[int, float]:
    """Shards 0, 1, ... with equal weights."""
    return {k: 1.0 for k in range(shards)}


def rendezvous(key: str | Column, weights: Mapping[int, float]) -> Column:
    """The shard of a record: the one with the smallest cost ``-ln(u) / weight``.

    ``u`` is a hash of the key and the shard's number, spread evenly over (0, 1), so a
    shard wins with a probability in proportion to its weight. The costs of a key depend on
    nothing else: a further shard takes exactly the keys for which its own cost is the
    smallest, a removed one gives up only its own keys, and a changed weight moves
    keys only to or from that shard. Equal costs go to the smaller number. Keys are
    compared as text, so 7 as int, long and text is the same key; a null key is one
    key of its own. Shards of weight 0 take nothing.
    """
    wanted = {int(k): float(w) for k, w in weights.items()}
    if any(not math.isfinite(w) or w < 0 for w in wanted.values()) or not any(wanted.values()):
        raise ValueError("weights are finite numbers from 0 on, not all of them 0")
    column = F.col(key) if isinstance(key, str) else key
    own = F.xxhash64(column.cast("string"))
    shards = F.array(*[F.struct(F.lit(k).alias("shard"), F.lit(w).alias("weight")) for k, w in sorted(wanted.items()) if w])

    def cost(shard: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(own, shard["shard"]), 64 - BITS) + F.lit(0.5)) * F.lit(2.0**-BITS)
        return F.struct((-F.log(unit) / shard["weight"]).alias("cost"), shard["shard"].alias("shard"))

    return F.array_min(F.transform(shards, cost))["shard"]


def assign(docs: DataFrame, weights: Mapping[int, float], key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """All rows and columns with the shard of each; no row is moved. A column named like ``shard`` is replaced."""
    return docs.withColumn(shard, rendezvous(key, weights))


def with_slots(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Rows with a gapless number from 0 within their shard.

    The rows are written once. A row's number is the count of its shard's rows in
    earlier read partitions plus its place in its own, so a window holds rows of one
    partition only, however many rows a shard or a key has. The numbers follow the
    stored order: the same files read alike give the same numbers. Rows with a null
    shard are numbered as one shard. A column named like ``slot`` is replaced.
    """
    names = [c for c in rows.columns if c != slot]
    packed = rows.select(F.struct(*names).alias("_row"), F.col(shard).alias("_shard"))
    placed = cut(packed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = placed.groupBy("_shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_shard").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    place = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy("_at")) - 1
    ranked = placed.withColumn("_place", place)
    joined = ranked.join(starts, F.col("_shard").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return joined.select("_row.*", (F.col("_start") + F.col("_place")).cast("long").alias(slot))


def size_and_checksum(text: str = "text") -> tuple[Column, Column]:
    """UTF-8 bytes of a text plus 1, and its unsigned CRC-32; null counts as empty."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return (F.octet_length(raw) + 1).cast("long"), F.crc32(raw)


def write_shards(
    docs: DataFrame, path: str, weights: Mapping[int, float], key: str = "doc_id", rows_per_file: int = 1_000_000
) -> DataFrame:
    """Write the records as one folder ``shard=k`` per shard and read them back.

    Rows are dealt out by shard and a hash of their place, in about as many parts as
    ``rows_per_file`` asks for, so no task writes a whole shard. A column ``shard`` of
    the records is replaced.
    """
    placed = assign(docs, weights, key)
    parts = max(len(weights), math.ceil(placed.count() / rows_per_file))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, math.ceil(parts / len(weights)))))
    placed.withColumn("_salt", salt).repartition(parts, "shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def moves(docs: DataFrame, old: Mapping[int, float], new: Mapping[int, float], key: str = "doc_id") -> DataFrame:
    """(old_shard, new_shard, n): how many records stay or move when the shards change."""
    pairs = docs.select(rendezvous(key, old).alias("old_shard"), rendezvous(key, new).alias("new_shard"))
    return pairs.groupBy("old_shard", "new_shard").agg(F.count(F.lit(1)).alias("n"))


def sharded(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, equal weights.

    The law is ``key``: the key and the number of shards decide alone. Copies of a text
    under other keys are thus spread, and rows with equal key stay together. With one
    more shard (``grown_shard``) a row stays where it is or goes to the new shard. Null
    keys are one key, null texts count as empty, repeated rows get a slot each,
    other columns are ignored, and an empty table gives no row.
    """
    size, checksum = size_and_checksum(text)
    plain = docs.select(
        F.col(key), size.alias("size"), checksum.alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(key, even_weights(shards)).alias("shard"), rendezvous(key, even_weights(shards + 1)).alias("grown_shard"),
    )
    return with_slots(plain).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
