"""Sketches stored per part and merged, against exact results."""

import random

import pytest
from pyspark.sql import functions as F

from encore.operators import sketches


@pytest.mark.parametrize("error", [0.02, 0.005])
def test_merged_quantiles_keep_their_rank_error(spark, tmp_path, error):
    rng = random.Random(4)
    rows = [(i % 13, rng.lognormvariate(0, 2)) for i in range(20_000)] + [(99, None)]
    df = spark.createDataFrame(rows, "part int, x double")
    path = str(tmp_path / "sketches")
    sketches.quantile_sketches(df.where("part < 6"), "x", ["part"], error).write.parquet(path)
    sketches.quantile_sketches(df.where("part >= 6"), "x", ["part"], error).write.mode("append").parquet(path)
    values = sorted(x for _, x in rows if x is not None)
    got = sketches.merged_quantiles(spark.read.parquet(path), [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]).collect()
    assert len(got) == 6
    for prob, value in got:
        rank = sum(v <= value for v in values) / len(values)
        assert abs(rank - prob) <= error + 1 / len(values)


def test_merged_distinct_counts_overlapping_parts(spark):
    rows = [(i % 9, f"t{i % 4000}", i % 50 if i % 3 else None) for i in range(30_000)]
    df = spark.createDataFrame(rows, "part int, track string, album int")
    stored = sketches.distinct_sketches(df, ["track", "album"], ["part"], 0.02)
    track, album = sketches.merged_distinct(stored, ["track", "album"]).first()
    assert abs(track - 4000) <= 0.02 * 4000 and abs(album - 50) <= 1


def test_empty_tables_and_impossible_errors(spark):
    none = spark.createDataFrame([], "part int, x int")
    assert sketches.merged_quantiles(sketches.quantile_sketches(none, "x", ["part"]), [0.5]).count() == 0
    assert sketches.merged_distinct(sketches.distinct_sketches(none, ["x"], ["part"]), ["x"]).first() == (0,)
    only_null = spark.createDataFrame([(1, None)], "part int, x int")
    assert sketches.merged_quantiles(sketches.quantile_sketches(only_null, "x", ["part"]), [0.5]).count() == 0
    for size, error in ((sketches.kll_size, 1e-9), (sketches.hll_size, 1e-6)):
        with pytest.raises(ValueError):
            size(error)
