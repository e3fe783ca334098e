"""Properties of the whole chain on the smallest test tables."""

from pyspark.sql import functions as F

from checks import load
from encore.operators import transitions
from encore.plans import continuation


def test_parts_are_disjoint_and_complete(tables):
    assert tables.parts.count() == tables.playlists.count() == tables.parts.select("pid").distinct().count()
    assert {r["part"] for r in tables.parts.select("part").distinct().collect()} == {"train", "dev", "test"}


def test_eval_tracks_occur_in_train(tables):
    held = tables.part_tracks.where("part <> 'train'").select("track_uri").distinct()
    assert held.join(tables.train, "track_uri", "left_anti").count() == 0


def test_seed_and_truth_make_the_list(tables):
    n = tables.part_tracks.where("part = 'test'").count()
    assert tables.seeds.count() + tables.truth.count() == n
    assert tables.truth.agg(F.min("pos")).first()[0] == 0


def test_recommendations_hold_no_seed_and_have_dense_ranks(tables):
    fitted = transitions.fit_transitions(tables.train)
    for method in (transitions.continue_full, transitions.continue_semi):
        recs = method(tables.seeds, fitted).cache()
        assert recs.join(tables.seeds, ["pid", "track_uri"], "left_semi").count() == 0
        per = recs.groupBy("pid").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"))
        assert per.where("m <> n or n > 500").count() == 0
        assert recs.select("pid", "track_uri").distinct().count() == recs.count()


def test_prepare_and_evaluate(tables):
    rows = continuation.prepare(tables.tracks, tables.playlists, 1, share=0.3, ks=(0, 1, 5, 10))
    report = continuation.evaluate_transitions(rows.where("part = 'train'"), rows.where("part = 'test'"))
    for r in report.collect():
        assert 0 <= r["r_prec"] <= 1 and 0 <= r["ndcg"] <= 1 and 0 <= r["recall"] <= 1 and 0 <= r["clicks"] <= 51


def test_features_from_entries(tables):
    mine = continuation.features(tables.tracks).select("pid", "num_tracks", "modified_at")
    theirs = tables.playlists.select("pid", "num_tracks", "modified_at")
    assert mine.exceptAll(theirs).count() == 0


def test_every_statement_belongs_to_a_query():
    queries, sql = load()
    assert set(sql) <= set(queries)
    assert len(queries) > 120


def test_p_values_against_closed_forms(spark):
    """Tails of the correlation for few pairs have closed forms; for many the integral is summed."""
    import math

    import numpy as np

    from encore.functions.significance import correlation_p_value

    def exact(r, n):
        s = abs(r)
        if n < 6:
            return {3: 1 - 2 / math.pi * math.asin(s), 4: 1 - s, 5: 1 - 2 / math.pi * (math.asin(s) + s * math.sqrt(1 - s * s))}[n]
        x, w = np.polynomial.legendre.leggauss(2000)

        def tail(low):
            half = (math.pi / 2 - low) / 2
            return half * (w * np.cos(low + half * (x + 1)) ** (n - 3)).sum()

        return tail(math.asin(s)) / tail(0)

    cases = [(r, n) for n in (3, 4, 5, 6, 7, 20, 101, 3000) for r in (0.0, 1e-4, -0.01, 0.1, -0.5, 0.9, 0.999999)]
    odd = [(1.0, 5), (-1.0, 50), (0.5, 2), (None, 9), (float("nan"), 9), (1e-5, 10**10), (0.3, 10**9)]
    rows = spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(cases + odd)], "i int, r double, n long")
    got = [x["p"] for x in rows.withColumn("p", correlation_p_value(F.col("r"), F.col("n"))).orderBy("i").collect()]
    for (r, n), p in zip(cases, got):
        assert abs(p - exact(r, n)) < 1e-9, (r, n, p, exact(r, n))
    tail = math.erfc(1e-5 * math.sqrt(10**10) / math.sqrt(2))
    assert got[len(cases) : -2] == [0.0, 0.0, None, None, None] and abs(got[-2] - tail) < 1e-7 and got[-1] == 0.0
