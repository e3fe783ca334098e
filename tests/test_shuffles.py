"""Steps that must not shuffle or repeat more than they need: ingest, popularity and title votes."""

from pyspark.sql import functions as F

from encore.operators import profile, title_match
from encore.sources.ordered import read_ordered, store_ordered
from encore.sources.star import Star


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def small_star(spark, folder):
    lines = [(o, p, p % 3, i, float(p)) for o in range(4) for i, p in enumerate((5, 2, 5))]
    lines += [(None, 5, 1, 9, 1.0), (0, None, 1, 9, 1.0)]
    orders = [(0, 7, "F", "2020-01-02"), (1, 7, "O", "2020-01-01"), (1, 7, "F", "2020-01-03"), (2, None, "F", "2020-01-01"), (3, 8, None, None)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string"),
        "part": ([(2, "red bolt", "Brand#1"), (5, None, "Brand#2")], "p_partkey long, p_name string, p_brand string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return Star(spark, str(folder))


def test_ingest_deals_no_row_out_twice(spark, tmp_path):
    star = small_star(spark, tmp_path)
    assert "Repartition" not in optimized(star._entries())


def test_playlist_features_count_orders_once(spark, tmp_path):
    """Order 1 stands twice, once as final, so both its rows are one edit and one follower."""
    star = small_star(spark, tmp_path)
    found = {r["pid"]: r for r in star.playlists.collect()}
    assert set(found) == {7, 8}
    seven = found[7]
    assert (seven["num_edits"], seven["num_followers"], seven["num_artists"], seven["num_albums"]) == (2, 2, 2, 1)
    assert (seven["num_tracks"], seven["duration_ms"], seven["modified_at"]) == (9, 36000, 18264 * 86400)
    assert (found[8]["num_edits"], found[8]["num_followers"], found[8]["modified_at"]) == (1, 0, None)


def test_popularity_features_group_once(spark, skewed):
    counts = profile.popularity(skewed)
    found = profile.popularity_features(skewed, counts, "track_uri", "track")
    above = optimized(found).split("Join")[0]
    below = optimized(found).split("Join")[1]
    assert above.count("Aggregate [") == 1 and "Aggregate [pid" not in below
    plain = skewed.join(counts, "track_uri").groupBy("pid").agg(
        F.sum("popularity"), F.avg("popularity"), F.percentile("popularity", 0.5), F.count(F.lit(1))
    )
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_positions_are_read_without_python(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") % 3 % 2).alias("pid"), F.col("id").alias("at"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    store_ordered(df, "pid", ["at"], str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = read_ordered(spark, "pid", str(tmp_path / "t"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "ExistingRDD" not in plan
    ends = {r["pid"]: (r["low"], r["high"], r["n"]) for r in found.groupBy("pid").agg(
        F.min("pos").alias("low"), F.max("pos").alias("high"), F.countDistinct("pos").alias("n")).collect()}
    assert ends == {0: (0, 2666, 2667), 1: (0, 1332, 1333)}


def vote_case(spark):
    train = spark.createDataFrame([(i, ("rock", "rocks", "jazz")[i % 3]) for i in range(30)], "pid long, name string")
    tracks = spark.createDataFrame([(i, p, f"t{(i * 7 + p) % 40}") for i in range(30) for p in range(5)], "pid long, pos long, track_uri string")
    lists = [(100 + i, ("Rock", "rock ", "JAZZ", None)[i % 4], i % 2) for i in range(40)] + [(None, "rock", 0)]
    return spark.createDataFrame(lists, "pid long, name string, k int"), train, tracks


def test_lists_of_one_title_share_a_vote(spark, monkeypatch):
    lists, train, tracks = vote_case(spark)
    near = title_match.voting_titles(lists, train, tracks, 6)
    expected = title_match.vote_by_title(near, tracks, 6)
    seen, vote = [], title_match.vote_by_title
    monkeypatch.setattr(title_match, "vote_by_title", lambda n, t, k: seen.append(n.select("pid").distinct().count()) or vote(n, t, k))
    found = title_match.title_recommend(lists, train, tracks, 6)
    assert seen == [2]
    assert found.columns == expected.columns and found.schema["pid"].dataType == expected.schema["pid"].dataType
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_titles_behind_enough_playlists_are_not_joined(spark, monkeypatch):
    lists, train, _ = vote_case(spark)
    facts, join = [], title_match.salted_join
    monkeypatch.setattr(title_match, "salted_join", lambda fact, dim, on, *a, **b: facts.append(fact.count()) or join(fact, dim, on, *a, **b))
    found = title_match.nearest_titles(lists.where("pid is not null"), train, 12)
    # Two titles hold twelve playlists for each of "rock" and "jazz"; the third is not joined.
    assert facts[0] == 4
    monkeypatch.undo()
    ranked = {(r["pid"], r["rank"]): r["distance"] for r in found.collect()}
    assert ranked[(100, 10)] == 0.0 and ranked[(100, 11)] == 1.0 and len(ranked) == 30 * 12
    short = title_match.nearest_titles(lists.where("pid is not null"), train, 10)
    assert {r["distance"] for r in short.collect()} == {0.0}
