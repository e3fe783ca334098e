import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from encore.sources.star import star

    return star(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def skewed(spark):
    """3,000 entries of 400 playlists; one playlist and one track hold a third each."""
    import random

    rng = random.Random(5)
    rows, places = [], {}
    for i in range(3000):
        pid = 7 if i % 3 == 0 else rng.randrange(400)
        track = "hot" if i % 3 == 1 else f"t{rng.randrange(300)}"
        places[pid] = places.get(pid, -1) + 1
        rows.append((pid, places[pid], track))
    return spark.createDataFrame(rows, "pid long, pos long, track_uri string").cache()
