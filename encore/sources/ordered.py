"""Positions inside long ordered lists, without one task per list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from encore.sources.workspace import is_complete


def store_ordered(df: DataFrame, key: str, order: list[str], path: str) -> None:
    """Write ``df`` sorted by ``key`` and ``order`` over the whole cluster.

    The range shuffle includes the order columns, so a list that holds a large
    part of the rows is spread over many tasks. Every row keeps the number of
    its partition and its place in that partition's run of the key.
    """
    rows = (
        df.repartitionByRange(key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    names = [*rows.columns, "_run"]
    at = rows.columns.index(key)

    def number(batches):
        import numpy as np
        import pyarrow as pa

        last, seen = None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            lengths = np.diff(np.append(starts, n))
            place = np.arange(n, dtype=np.int64) - np.repeat(starts, lengths)
            if last is not None and keys[0] == last:
                place[: lengths[0]] += seen
            last, seen = keys[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=names)

    schema = T.StructType([*rows.schema.fields, T.StructField("_run", T.LongType())])
    rows.mapInArrow(number, schema).write.mode("overwrite").parquet(path)


def read_ordered(spark: SparkSession, key: str, path: str, name: str = "pos") -> DataFrame:
    """Read a table of :func:`store_ordered` with the zero-based position in the list.

    Only the first list of a partition can have begun in an earlier one. One row
    per partition is enough to know how much of it lies there.
    """
    rows = spark.read.parquet(path)
    ends = (
        rows.groupBy("_part")
        .agg(
            F.min(key).alias("first"),
            F.max(key).alias("last"),
            F.max_by("_run", F.struct(key, "_run")).alias("run"),
        )
        .orderBy("_part")
        .collect()
    )
    carried, open_key, open_rows = [], None, 0
    for end in ends:
        before = open_rows if end["first"] == open_key else 0
        if before:
            carried.append((end["_part"], end["first"], before))
        open_rows = end["run"] + 1 + (before if end["last"] == end["first"] else 0)
        open_key = end["last"]
    if not carried:
        return rows.withColumnRenamed("_run", name).drop("_part")
    # As literals: a local list would start Python workers for each scan of the table.
    cells = [
        F.struct(F.lit(p).cast("int").alias("_part"), F.lit(k).cast("long").alias("_key"), F.lit(n).cast("long").alias("_before"))
        for p, k, n in carried
    ]
    before = spark.range(1).select(F.inline(F.array(*cells)))
    return (
        rows.join(F.broadcast(before), "_part", "left")
        .withColumn(
            name,
            F.col("_run") + F.when(F.col(key) == F.col("_key"), F.col("_before")).otherwise(0),
        )
        .drop("_part", "_run", "_key", "_before")
    )


def ordered(spark: SparkSession, build, key: str, order: list[str], path: str) -> DataFrame:
    """Build the ordered table once per application, then read it."""
    if not is_complete(spark, path):
        store_ordered(build(), key, order, path)
    return read_ordered(spark, key, path)
