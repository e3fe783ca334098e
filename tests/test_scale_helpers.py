"""Ranks, joins and positions that must not depend on how keys are spread."""

import random

import numpy as np
from pyspark.sql import Window, functions as F

from encore.operators import ranking, segments
from encore.operators.nearest import nearest
from encore.operators.quantiles import quantile_row
from encore.operators.skew import heavy_keys, salted_join
from encore.sources.ordered import read_ordered, store_ordered
from encore.sources.workspace import stored, workspace


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_positions_of_a_list_over_many_partitions(spark, tmp_path):
    data = [(1 if i % 3 else i % 50, i * 37 % 5000) for i in range(5000)]
    df = spark.createDataFrame(data, "pid long, at long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    store_ordered(df, "pid", ["at"], str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = read_ordered(spark, "pid", str(tmp_path / "t"))
    parts = spark.read.parquet(str(tmp_path / "t")).where("pid = 1").select("_part").distinct().count()
    assert parts > 1
    expected = df.withColumn("pos", F.row_number().over(Window.partitionBy("pid").orderBy("at")) - 1)
    assert rows(found.select("pid", "at", "pos")) == rows(expected.select("pid", "at", F.col("pos").cast("long")))


def test_split_rank_equals_one_window(spark):
    data = [(i % 3, i // 10 % 7, f"{random.Random(i).random():.9f}") for i in range(2000)]
    df = spark.createDataFrame(data, "k int, length int, h string").withColumn("b", F.substring("h", 1, 3))
    mine = ranking.split_rank(df, ["h"], "rank", ["k"], ["length", "b"])
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("length", "h")).cast("long"))
    assert rows(mine.select("k", "length", "h", "rank")) == rows(plain.select("k", "length", "h", "rank"))


def test_salted_join_equals_plain_join(spark, skewed):
    counts = skewed.groupBy("track_uri").agg(F.count(F.lit(1)).alias("n"))
    assert [r[0] for r in heavy_keys(counts, "track_uri", "n")].count("hot") == 1
    for how in ("inner", "left"):
        dim = counts.where("track_uri <> 't5'")
        salted = salted_join(skewed, dim, "track_uri", "n", how=how)
        plain = skewed.join(dim, "track_uri", how)
        columns = ["pid", "pos", "track_uri", "n"]
        order = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
        assert order(salted) == order(plain)


def test_salted_join_counts_keys_of_the_fact(spark, skewed):
    many = spark.createDataFrame([("hot", 1), ("hot", 2), ("t1", 3)], "track_uri string, v int")
    assert rows(salted_join(skewed, many, "track_uri").select("pid", "pos", "v")) == rows(
        skewed.join(many, "track_uri").select("pid", "pos", "v")
    )


def test_heavy_keys_are_bounded(spark):
    flat = spark.range(10_000).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    assert heavy_keys(flat, "k", "n") == []
    steep = spark.range(300).select(F.col("id").alias("k"), F.lit(5).alias("n"))
    assert len(heavy_keys(steep, "k", "n")) < 256


def test_quantiles_by_blocks_equal_one_task(spark):
    rng = random.Random(1)
    values = [rng.choice([1, 1, 2, 5, rng.randrange(1000), rng.random() * 50]) for _ in range(3000)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs, names = [0.1, 0.25, 0.5, 0.77, 1.0], list("abcde")
    expected = np.quantile(values, probs)
    for one_task in (1_000_000, 0):
        found = quantile_row(df, "x", probs, names, one_task).first()
        assert np.allclose(list(found), expected)


def test_segments_overlap_and_cut(spark):
    df = spark.range(25).select(F.lit(1).alias("pid"), F.col("id").alias("pos"), F.col("id").alias("v"))
    cut = segments.segments(df, "pos", "v", ["pid"], overlap=3, width=10)
    found = {r["start"]: r["items"] for r in cut.collect()}
    assert found == {0: list(range(13)), 10: list(range(10, 23)), 20: list(range(20, 25))}


def test_windows_of_a_long_list(spark, skewed):
    """Windows across segment borders equal a plain Python slide."""
    lists = {}
    for r in skewed.orderBy("pid", "pos").collect():
        lists.setdefault(r["pid"], []).append(r["track_uri"])
    expected = sorted(
        (p, s, tuple(x[s : s + 3]), tuple(x[s + 1 : s + 4])) for p, x in lists.items() for s in range(len(x) - 3)
    )
    found = segments.playlist_windows(skewed, 3, "track_uri")
    assert sorted((r[0], r[1], tuple(r[2]), tuple(r[3])) for r in found.collect()) == expected


def test_next_items_with_gap(spark, skewed):
    lists = {}
    for r in skewed.orderBy("pid", "pos").collect():
        lists.setdefault(r["pid"], []).append(r["track_uri"])
    expected = sorted((p, x[i], x[i + g], g) for p, x in lists.items() for g in (1, 2) for i in range(len(x) - g))
    assert rows(segments.next_items(skewed, max_gap=2)) == expected


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_nearest_titles_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 9)))
    names, asked = sorted({word() for _ in range(80)}), sorted({word() for _ in range(25)})
    base = spark.createDataFrame([(n, str(i % 7), n) for i, n in enumerate(names)], "name string, tie string, item string")
    queries = spark.createDataFrame([(q, q) for q in asked], "query string, item string")
    ties = {n: str(i % 7) for i, n in enumerate(names)}
    expected = sorted(
        (q, n, d)
        for q in asked
        for d, _, n in sorted((edit(q, n), ties[n], n) for n in names)[:5]
    )
    small = nearest(base, queries, 5)
    grid = nearest(base, queries, 5, max_broadcast=3)
    for found in (small, grid):
        got = {(r["query"], r["rank"]): (r["cost"], ties[r["name"]]) for r in found.collect()}
        want = {}
        for q in asked:
            for i, (d, t, _) in enumerate(sorted((edit(q, n), ties[n], n) for n in names)[:5], 1):
                want[(q, i)] = (d, t)
        assert got == want
    assert len(expected) == 5 * len(asked)


def test_stored_table_is_built_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = f"{workspace(spark)}/test_stored"
    assert stored(spark, path, build).count() == 3
    assert stored(spark, path, build).count() == 3
    assert len(calls) == 1
    stored(spark, path, build, recompute=True)
    assert len(calls) == 2


def test_top_k_cuts_before_the_shuffle(spark, skewed):
    plan = ranking.top_k_per(skewed, ["track_uri"], ["pid", "pos"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > 0


def test_pruned_distances_keep_the_nearest():
    from encore.operators.nearest import _edit_costs

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij_é") for _ in range(rng.randrange(0, 14)))
    texts = sorted({word() for _ in range(1500)})
    costs = _edit_costs(texts, 20)
    skipped = 0
    for query in [word() for _ in range(8)]:
        found = costs(query)
        exact = np.array([edit(query, t) for t in texts], dtype=float)
        limit = np.sort(exact)[19]
        assert (found[exact <= limit] == exact[exact <= limit]).all()
        assert (found[~np.isinf(found)] == exact[~np.isinf(found)]).all()
        skipped += np.isinf(found).sum()
    assert skipped > 0


def test_largest_inner_products_equal_the_model(spark):
    from encore.operators import factorisation

    rng = random.Random(6)
    pairs = spark.createDataFrame([(rng.randrange(20), f"t{rng.randrange(40)}") for _ in range(200)], "pid long, track_uri string")
    none = pairs.limit(0)
    ratings = factorisation.interactions(pairs, none).cache()
    model = factorisation.fit_wmf(ratings, rank=4, iterations=2)
    mine = factorisation.wmf_recommend(model, ratings, ratings, n=5)
    known = {(r["user"], r["item"]) for r in ratings.collect()}
    want = {
        r["user"]: [x["item"] for x in r["recommendations"] if (r["user"], x["item"]) not in known][:5]
        for r in model.recommendForAllUsers(45).collect()
    }
    got = {}
    for r in mine.orderBy("user", "rank").collect():
        got.setdefault(r["user"], []).append(r["item"])
    assert got == want


def test_recommendations_are_whole_for_a_user_with_many_known_items(spark):
    from encore.operators import factorisation

    rows = [(0, f"t{i}") for i in range(150)] + [(1, f"t{i}") for i in range(100, 200)]
    pairs = spark.createDataFrame(rows, "pid long, track_uri string")
    ratings = factorisation.interactions(pairs, pairs.limit(0)).cache()
    model = factorisation.fit_wmf(ratings, rank=2, iterations=1)
    found = factorisation.wmf_recommend(model, ratings, ratings, n=50)
    assert {r["user"]: r["count"] for r in found.groupBy("user").count().collect()} == {0: 50, 1: 50}
    assert found.join(ratings, ["user", "item"]).isEmpty()


def test_no_cross_joins_and_no_single_task_over_rows(tables):
    """Neighbour searches must not be planned as cross joins."""
    from checks import load

    for name in ("c4_nearest_by_edit_distance", "i8_similar_playlists", "k3_continue_full", "j5_interleave"):
        plan = load()[0][name](tables.spark, tables.folder)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan
