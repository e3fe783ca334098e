"""Prefix sums over sampled ranges, against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from encore.operators.ranges import range_prefix_sum, range_rank
from encore.operators.ranking import accumulate_until, ordered_distinct
from encore.operators.vocab import corpus


def rows_with_hot_key(n=3000):
    """A third of all rows in one key; null keys and null values; ids far apart."""
    rng = random.Random(3)
    steps = rng.sample(range(-(10**15), 10**15), n)
    return [
        (None if i % 7 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(60)}", s, None if i % 11 == 0 else rng.randrange(9))
        for i, s in enumerate(steps)
    ]


def test_sums_carry_over_ranges(spark):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "key string, step long, value long")
    sums, expected = defaultdict(int), {}
    for key, step, value in sorted(rows, key=lambda r: r[1]):
        expected[key, step] = sums[key]
        sums[key] += value or 0
    for parts in (1, 7, 40):
        got = range_prefix_sum(df, "value", ["step"], "before", ["key"], parts)
        assert got.columns == [*df.columns, "before"]
        assert {(r["key"], r["step"]): r["before"] for r in got.collect()} == expected
    assert range_prefix_sum(df.limit(0), "value", ["step"], "before", ["key"]).count() == 0


def test_a_hot_key_lies_in_many_ranges(spark):
    df = spark.createDataFrame(rows_with_hot_key(), "key string, step long, value long")
    parts = df.repartitionByRange(40, "key", "step").withColumn("part", F.spark_partition_id())
    most = parts.groupBy("part").count().agg(F.max("count")).first()[0]
    assert parts.where("key = 'hot'").select("part").distinct().count() > 8 and most < 300


def test_ranks_without_keys(spark):
    rows = rows_with_hot_key(500)
    df = spark.createDataFrame(rows, "key string, step long, value long")
    ranked = range_rank(df, ["step"], parts=9).orderBy("step").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 501))


def test_offsets_over_hashed_ids(spark, skewed):
    spread = skewed.select(F.xxhash64("pid").alias("pid"), "pos", F.lit(1).alias("item_id"))
    got = corpus(spread).orderBy("offset").collect()
    assert [r["offset"] for r in got] == list(range(len(got)))
    assert [(r["pid"], r["pos"]) for r in got] == sorted((r["pid"], r["pos"]) for r in got)


def test_accumulated_steps_and_first_places_of_a_hot_list(spark, skewed):
    rows = [(r["pid"], r["pos"], r["track_uri"]) for r in skewed.collect()]
    lists = defaultdict(list)
    for pid, pos, track in sorted(rows):
        lists[pid].append((pos, track))
    kept, places = set(), set()
    for pid, entries in lists.items():
        seen, order = set(), []
        for pos, track in entries:
            if len(seen) < 20:
                kept.add((pid, pos, track))
            if track not in order:
                order.append(track)
            seen.add(track)
        places |= {(pid, track, i + 1) for i, track in enumerate(order)}
    got = accumulate_until(skewed, "pid", "pos", "track_uri", 20)
    assert sorted(got.columns) == sorted(skewed.columns)
    assert {(r["pid"], r["pos"], r["track_uri"]) for r in got.collect()} == kept
    found = ordered_distinct(skewed.withColumnRenamed("pos", "rank"), "pid", "track_uri")
    assert {(r["pid"], r["track_uri"], r["rank"]) for r in found.collect()} == places
