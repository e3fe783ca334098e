"""Stored tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workspace(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``.

    Without that setting a local session gets a folder of its own; a cluster
    session is refused, as its executors would not see a folder of the driver.
    """
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/encore-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="encore-")
    return _own[app]


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a write to ``path`` was committed."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Writes inside remove their shuffle files when they end: what is written is read instead."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def stored(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    recompute: bool = False,
) -> DataFrame:
    """Load the table at ``path``; build and write it first if needed."""
    if recompute or not is_complete(spark, path):
        rows = build()
        with cleaned(spark):
            rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Split the rows of a few large files over all cores; many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_at(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """:func:`cut` with the folder it is written to, one folder below for each value of ``by``."""
    path = f"{workspace(df.sparkSession)}/cuts/{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches need, and read it back.

    Its lineage ends here, and its true size is known to the planner.
    """
    path = f"{workspace(df.sparkSession)}/cuts/{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_cut(spark: SparkSession, path: str) -> None:
    """Remove a folder of :func:`cut_at` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
