"""Approximate title search by random projections against the exact search."""

import numpy as np
import pytest

from encore.operators import title_vectors


def test_approximate_search_keeps_its_recall(spark):
    rng = np.random.default_rng(5)
    heart = rng.normal(size=(30, 12))
    x = heart[rng.integers(0, 30, 500)] + 0.25 * rng.normal(size=(500, 12))
    vectors = spark.createDataFrame([(f"t{i}", v.tolist()) for i, v in enumerate(x)] + [("none", [0.0] * 12)], "name string, vec array<double>")
    train = spark.createDataFrame([(i, f"t{i % 450}") for i in range(600)] + [(900, None), (901, "none")], "pid long, name string")
    lists = spark.createDataFrame([(1000 + i, f"t{450 + i}") for i in range(50)] + [(2000, "none"), (2001, None)], "pid long, name string")
    exact = {(r["pid"], r["candidate"]): r["similarity"] for r in title_vectors.similar_playlists(lists, train, vectors, 600).collect() if r["similarity"] >= 0.9}
    rows = title_vectors.similar_playlists_approx(lists, train, vectors, 600).collect()
    found = {(r["pid"], r["candidate"]): r["similarity"] for r in rows}
    assert len(exact) > 200 and len(found) == len(rows)
    assert all(exact[p] == pytest.approx(s, abs=1e-9) for p, s in found.items())
    assert len(found) >= 0.9 * len(exact)
    few = title_vectors.similar_playlists_approx(lists, train, vectors, 3).collect()
    assert max(r["rank"] for r in few) == 3
    assert title_vectors.similar_playlists_approx(lists, train, vectors.limit(0)).count() == 0


def test_tables_grow_with_the_recall():
    assert title_vectors.hash_tables(0.9, 0.99, 1.0) > title_vectors.hash_tables(0.9, 0.9, 1.0) >= 1
