"""Inner-product search with bounds, groups and known pairs against brute force."""

import numpy as np
import pytest

from encore.operators import bounded_search, factorisation, item_vectors


def vectors(seed, n, size, centres, spread):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(centres, size))
    x = heart[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, size))
    x[5] = x[6] = x[7]  # ties
    return x


def brute(x, q, k, cap=None, groups=None, own=None, known=()):
    score = (x * q).sum(1)
    out, held = [], {}
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        if i in known or (cap and own is not None and groups[i] == own):
            continue
        if cap and held.get(groups[i], 0) >= cap:
            continue
        if cap:
            held[groups[i]] = held.get(groups[i], 0) + 1
        out.append(i)
    return out[:k]


@pytest.mark.parametrize("k, cap, listed, spread", [(20, None, True, 0.1), (30, 2, False, 1.0), (600, 3, True, 0.2)])
def test_search_matches_brute_force(spark, monkeypatch, k, cap, listed, spread):
    """Small cells, so that clusters have parts and queries have blocks."""
    for name, value in (("ROWS_PER_CENTRE", 32), ("CELL_ROWS", 50), ("CELL_QUERIES", 8), ("SCORES", 100)):
        monkeypatch.setattr(bounded_search, name, value)
    n, m, size = 600, 20, 6
    x, q = vectors(k, n, size, 12, spread), vectors(k + 1, m, size, 12, spread)
    rng = np.random.default_rng(k)
    groups, own = rng.integers(0, 25, n).tolist(), rng.integers(0, 25, m).tolist()
    groups[3], own[2] = None, None
    known = {(j, int(i)) for j in range(m) for i in rng.integers(0, n, 15)} if listed else set()
    base = spark.createDataFrame([(i, i, x[i].tolist(), groups[i]) for i in range(n)] + [(n, n, None, 1)], "name long, tie long, item array<double>, group long")
    asked = spark.createDataFrame([(j, q[j].tolist(), own[j] if cap else None) for j in range(m)] + [(m, None, 1)], "query long, item array<double>, own long")
    pairs = spark.createDataFrame(sorted(known), "query long, name long") if listed else None
    found, visits = bounded_search.search(base, asked, k, cap, pairs)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append(r["name"])
        assert np.isclose(-r["cost"], (x[r["name"]] * q[r["query"]]).sum(), atol=1e-12)
    for j in range(m):
        assert got[j] == brute(x, q[j], k, cap, groups, own[j], {i for a, i in known if a == j})
    share = bounded_search.visited_share(visits, n, m)
    assert 0 < share <= 1 and (spread > 0.1 or share < 0.9)
    assert bounded_search.search(base.limit(0), asked, k)[0].count() == 0
    assert bounded_search.search(base, asked.limit(0), k)[0].count() == 0


def test_a_label_with_most_vectors_does_not_empty_a_list(spark):
    """12,000 items of the seed's artist are nearer than all others."""
    rows = [(f"h{i:05}", [1.0, i / 1e6], "hot") for i in range(12000)]
    rows += [(f"o{i:03}", [1.0, 1.0 + i / 100], f"a{i // 5}") for i in range(100)] + [("n1", [1.0, 0.5], None), ("none", [0.0, 0.0], "z")]
    table = spark.createDataFrame(rows, "item string, vec array<double>, artist string")
    seeds = spark.createDataFrame([("h00000",), ("n1",), ("none",), ("absent",)], "item string")
    found = item_vectors.diverse_items(table, seeds, table.select("item", "artist"), limit=50).orderBy("rank").collect()
    hot = [r["item"] for r in found if r["seed"] == "h00000"]
    assert hot[:4] == ["n1", "o000", "o001", "o002"] and len(hot) == 50 and hot[4] == "o005"
    assert [r["artist"] for r in found if r["seed"] == "n1"].count("hot") == 3
    assert {r["seed"] for r in found} == {"h00000", "n1"} and None not in [r["artist"] for r in found if r["seed"] == "n1"]
    own = item_vectors.diverse_items(table, seeds, table.select("item", "artist"), diff_artist=False, limit=5).where("seed = 'h00000'")
    assert [r["item"] for r in own.orderBy("rank").collect()] == ["h00001", "h00002", "h00003", "n1", "o000"]


def test_diverse_items_equal_diversified_neighbours(spark):
    x = vectors(4, 300, 5, 10, 0.3)
    table = spark.createDataFrame([(f"i{i}", x[i].tolist(), f"a{i % 13}") for i in range(300)], "item string, vec array<double>, artist string")
    seeds, artists = table.limit(20).select("item"), table.select("item", "artist")
    near = item_vectors.similar_items(table, seeds)
    assert near.groupBy("seed").count().where("count <> 299").count() == 0
    columns = ["seed", "rank", "item", "artist"]
    slow = item_vectors.diversify(near, artists, limit=30).select(columns)
    fast = item_vectors.diverse_items(table, seeds, artists, limit=30).select(columns)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


def test_recommendations_by_given_factors(spark):
    rng = np.random.default_rng(3)
    users, items = rng.normal(size=(12, 4)), rng.normal(size=(80, 4)) * rng.random((80, 1)) * 3
    known = {(u, int(i)) for u in range(12) for i in rng.integers(0, 80, 5)} | {(0, i) for i in range(70)}
    factors = spark.createDataFrame([(u, users[u].tolist()) for u in range(12)], "user int, factors array<double>")
    table = spark.createDataFrame([(i, items[i].tolist()) for i in range(80)], "item int, factors array<double>")
    pairs = spark.createDataFrame(sorted(known), "user int, item int")
    got = {}
    for r in factorisation.recommend_by_factors(factors, table, pairs.union(pairs), 20).orderBy("user", "rank").collect():
        got.setdefault(r["user"], []).append(r["item"])
    assert got == {u: brute(items, users[u], 20, known={i for a, i in known if a == u}) for u in range(12)}
    assert len(got[0]) == 10


def test_blocks_pass_on_k_rows_per_query_whatever_the_clusters(spark, monkeypatch):
    """With enough blocks lists are final in their task; known pairs and ties cross batch borders."""
    for name, value in (("ROWS_PER_CENTRE", 32), ("CELL_ROWS", 50), ("CELL_QUERIES", 2), ("SCORES", 100), ("PAIRS", 64)):
        monkeypatch.setattr(bounded_search, name, value)
    x, q = vectors(8, 400, 4, 9, 0.3), vectors(9, 24, 4, 9, 0.3)
    x[100:180] = x[100]  # more equal rows than a list is long
    known = {(j, i) for j in range(24) for i in (5, 6, 100, 101, 300 + j)}
    base = spark.createDataFrame([(i, i, x[i].tolist()) for i in range(400)], "name long, tie long, item array<double>")
    asked = spark.createDataFrame([(j, q[j].tolist()) for j in range(24)], "query long, item array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found, _ = bounded_search.search(base, asked, 20, known=spark.createDataFrame(sorted(known), "query long, name long"))
        assert "Window" not in found._jdf.queryExecution().toString()
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
            got.setdefault(r["query"], []).append(r["name"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {j: brute(x, q[j], 20, known={i for a, i in known if a == j}) for j in range(24)}


def test_grid_deals_out_the_fewer_bytes():
    """Many queries are cut into blocks only; few queries over many rows into slices."""
    assert bounded_search._grid(1_200_000, 32, 250_000, 500, 24) == (8192, 1)
    limit, slices = bounded_search._grid(1_200_000, 32, 100, 500, 24)
    assert (limit, slices) == (100, 32)
    assert bounded_search._blocks([(0, 3), (1, 4), (2, 25), (3, 1)], 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1)]


def got_lists(found):
    lists = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        lists.setdefault(r["query"], []).append(r["name"])
    return lists


def test_no_rows_are_dealt_out_to_blocks(spark, monkeypatch):
    """Many blocks read the packed rows where they were written once, near clusters first."""
    for name, value in (("ROWS_PER_CENTRE", 16), ("CELL_QUERIES", 2), ("PACK_BYTES", 2000)):
        monkeypatch.setattr(bounded_search, name, value, raising=False)
    x = vectors(21, 300, 5, 8, 0.3)
    known = {(j, j) for j in range(24)} | {(j, 6) for j in range(24)}
    base = spark.createDataFrame([(i, i, x[i].tolist()) for i in range(300)], "name long, tie long, item array<double>")
    asked = spark.createDataFrame([(j, x[j].tolist()) for j in range(24)], "query long, item array<double>")
    pairs = spark.createDataFrame(sorted(known), "query long, name long")
    for k in (15, 300):
        found, _ = bounded_search.search(base, asked, k, known=pairs)
        assert "Exchange" not in found._jdf.queryExecution().toString()
        assert got_lists(found) == {j: brute(x, x[j], k, known={i for a, i in known if a == j}) for j in range(24)}


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e25])
def test_single_precision_loses_no_row(spark, scale):
    """Scores that only doubles tell apart, also where single precision would over- or underflow."""
    rng = np.random.default_rng(11)
    x = np.ones((200, 3)) + rng.permutation(200)[:, None] * 1e-10
    base = spark.createDataFrame([(i, i, (x[i] * scale).tolist(), f"g{i % 3}") for i in range(200)], "name long, tie long, item array<double>, group string")
    asked = spark.createDataFrame([(j, x[j].tolist(), "g1") for j in range(4)], "query long, item array<double>, own string")
    plain = got_lists(bounded_search.search(base, asked.drop("own"), 20)[0])
    capped = got_lists(bounded_search.search(base, asked, 20, cap=4)[0])
    for j in range(4):
        assert plain[j] == brute(x * scale, x[j], 20)
        assert capped[j] == brute(x * scale, x[j], 20, 4, [f"g{i % 3}" for i in range(200)], "g1")


def test_seeds_come_first_or_not_at_all(spark):
    """A null is no seed's name."""
    seeds = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (1, 5, "b"), (2, 1, "b"), (2, 4, None)], "pid long, pos long, track_uri string")
    lists = spark.createDataFrame([("a", 1, "b"), ("a", 2, "c"), ("a", 3, None), ("b", 1, "d"), ("b", 2, "a"), ("b", 3, "c")], "seed string, rank int, item string")
    bare = item_vectors.interleave_seeds(seeds, lists)
    assert sorted(map(tuple, bare.collect()), key=str) == sorted([(1, 1, "d"), (1, 2, "c"), (1, 3, None), (2, 1, "d"), (2, 2, "a"), (2, 3, "c")], key=str)
    own = item_vectors.interleave_seeds(seeds, lists, with_seeds=True).where("pid = 1").orderBy("rank").collect()
    assert [r["track_uri"] for r in own] == ["a", "b", "d", "c", None]
