"""Stored tables: their shuffle files go when they are written."""

import time

from encore.sources.workspace import CLEAN, cut, stored


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    before = shuffled(spark)
    rows = spark.range(5000).groupBy("id").count()
    assert len(cut(rows).collect()) == 5000
    assert len(stored(spark, str(tmp_path / "kept"), lambda: rows.repartition(3, "count")).collect()) == 5000
    assert spark.conf.get(CLEAN) == "false"
    for _ in range(100):
        if not shuffled(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffled(spark) - before
