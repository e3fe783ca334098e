"""Rendezvous hashing against a second implementation, its laws, odd rows and files."""

import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from encore.llm import queries, sharding

SMALL = "/root/testdata/sf0.001"


def shard_of(key, weights):
    """The same law in plain Python."""
    own = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), seed=42)
    costs = []
    for shard, weight in sorted(weights.items()):
        if weight:
            h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=xxhash.xxh64_intdigest(struct.pack("<Q", own), seed=42))
            costs.append((-math.log(((h >> 11) + 0.5) * 2.0**-53) / weight, shard))
    return min(costs)[1]


def test_shards_match_the_second_implementation(spark):
    rows = queries.op13(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    places = {}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == shard_of(r["doc_id"], sharding.even_weights(16))
        assert r["grown_shard"] == shard_of(r["doc_id"], sharding.even_weights(17))
        assert r["grown_shard"] in (r["shard"], 16)
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted(map(tuple, queries.op13(spark, SMALL).collect())) == sorted(map(tuple, rows))


def test_weights_decide_the_shares_and_move_few_records(spark):
    weights = {0: 1.0, 1: 2.0, 2: 5.0, 7: 0.0}
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(keys, weights).collect()}
    assert got[17] == shard_of(17, weights)
    shares = Counter(got.values())
    assert set(shares) == {0, 1, 2}
    assert all(abs(shares[s] / 20000 - w / 8) < 0.015 for s, w in weights.items())
    heavier = sharding.moves(keys, weights, weights | {1: 4.0}).collect()
    assert all(r["new_shard"] in (r["old_shard"], 1) for r in heavier)
    fewer = sharding.moves(keys, weights, {0: 1.0, 2: 5.0}).collect()
    assert all(r["new_shard"] == r["old_shard"] or r["old_shard"] == 1 for r in fewer)
    assert sum(r["n"] for r in fewer) == 20000
    for bad in ({}, {0: 0.0}, {0: -1.0, 1: 1.0}, {0: math.nan}):
        with pytest.raises(ValueError):
            sharding.rendezvous("doc_id", bad)


def test_keys_are_text(spark):
    one = spark.sql("SELECT 7 AS a, 7L AS b, '7' AS c")
    weights = sharding.even_weights(16)
    row = one.select(*[sharding.rendezvous(c, weights).alias(c) for c in "abc"]).first()
    assert row["a"] == row["b"] == row["c"] == shard_of(7, weights)


def test_odd_rows_and_hot_keys(spark):
    long = "ä " * 50_000
    rows = [(1, "x"), (1, "x"), (1, "x"), (1, "y"), (None, None), (None, "z"), (2, ""), (3, None), (4, long), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(9) for c in ("shard", "slot", "size", "law", "grown_shard", "_part", "_at", "_row", "_shard", "_n", "_s")}
    )
    got = sharding.sharded(df, 4).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows
    )
    assert {r["shard"] for r in got if r["doc_id"] == 1} == {shard_of(1, sharding.even_weights(4))}
    assert {r["shard"] for r in got if r["doc_id"] is None} == {shard_of(None, sharding.even_weights(4))}
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.sharded(df.limit(0), 4).count() == 0
    numbered = sharding.with_slots(df.repartition(3)).collect()
    assert sorted(r["slot"] for r in numbered) == list(range(len(rows))) and numbered[0]["shard"] == 9


def test_written_shards_hold_every_record_once(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    weights = sharding.even_weights(3)
    back = sharding.write_shards(docs, str(tmp_path / "out"), weights, rows_per_file=100)
    found = {r["doc_id"]: (r["text"], r["shard"]) for r in back.collect()}
    assert found == {k: (f"t{k}", shard_of(k, weights)) for k in range(1000)}
    assert len(list((tmp_path / "out" / "shard=0").glob("*.parquet"))) > 1
