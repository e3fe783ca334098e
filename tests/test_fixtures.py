"""Hand-sized cases with known results."""

import json
import math

import pytest
from pyspark.sql import functions as F

from encore.functions import titles
from encore.functions.classes import edge_class, quantile_class
from encore.functions.text import EMOJI, clean_html, words
from encore.operators import (
    binning, item_vectors, lookups, metrics, profile, ranking, segments, split, textmining, title_match,
    title_vectors, transitions, vocab,
)
from encore.sources import recfiles, slices, tables as stored_tables


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def entries(spark, lists, name="track_uri"):
    rows = [(p, i, t) for p, items in lists.items() for i, t in enumerate(items)]
    return spark.createDataFrame(rows, f"pid long, pos long, {name} string")


def test_edge_class(spark):
    edges = F.array(*map(F.lit, [1, 10, 100, 200]))
    found = values(spark, lambda v: edge_class(v, edges), [1, 9, 11, 10, 90, 101, 199, 200, 204], "int")
    assert found == [0, 0, 1, 1, 1, 2, 2, 3, 3]


def test_quantile_edges_and_class(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (4.0,)], "x double")
    edges = [r["edge"] for r in binning.quantile_edges(df, "x", 4).orderBy("idx").collect()]
    assert edges == [1.0, 1.75, 4.0]
    array = F.array(*map(F.lit, edges))
    assert values(spark, lambda v: quantile_class(v, array), [1.0, 1.5, 4.0, 5.0], "double") == [0, 1, 2, None]


def test_doane_uses_the_published_sigma(spark):
    df = spark.range(1, 101).select((F.col("id") * F.col("id")).alias("x"))
    row = binning.doane(df, "x").first()
    assert math.isclose(row["sigma"], math.sqrt(6 * 98 / (101 * 103)))


def score(spark, truth, recs):
    t = entries(spark, {1: truth})
    r = entries(spark, {1: recs}).withColumn("rank", F.col("pos") + 1)
    return metrics.per_playlist_metrics(r, t).first()


def test_metrics_of_the_small_case(spark):
    row = score(spark, ["1", "2", "3", "5", "8", "99"], ["5", "8", "13", "3"])
    assert row["r_prec"] == 0.5 and row["recall"] == 0.5
    assert math.isclose(row["dcg"], 2.061606, abs_tol=1e-6)
    assert math.isclose(row["ndcg"], 0.623847, abs_tol=1e-6)


@pytest.mark.parametrize("hit,clicks", [(0, 0.0), (9, 0.0), (10, 1.0), (499, 49.0), (500, 51.0)])
def test_clicks(spark, hit, clicks):
    assert score(spark, [str(hit)], [str(i) for i in range(501)])["clicks"] == clicks


def test_duplicates_in_truth_and_predictions(spark):
    row = score(spark, ["a", "a", "b", "c"], ["a", "a", "x", "b", "b"])
    assert row["r_prec"] == 3 / 4
    assert row["recall"] == 2 / 4
    gain = 1 + 1 / math.log2(4)
    assert math.isclose(row["ndcg"], gain / (1 + 1 / math.log2(3) + 1 / math.log2(4)))


def test_lists_without_truth_or_predictions_drop_out(spark):
    truth = entries(spark, {1: ["a"], 2: ["b"]})
    recs = entries(spark, {1: ["a"], 3: ["a"]}).withColumn("rank", F.col("pos") + 1)
    assert [r["pid"] for r in metrics.per_playlist_metrics(recs, truth).collect()] == [1]


def test_bucket_means_are_averaged(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 0.0), (5, 1.0)], "k int, r double")
    found = {r["k"]: r["r"] for r in profile.bucket_means(rows, "k", ["r"]).collect()}
    assert found == {"0": 0.5, "5": 1.0, "avg": 0.75}


def test_tf_idf(spark):
    docs = spark.createDataFrame(
        [(1, "this is a a sample"), (2, "this is another another example example example")], "doc_id long, text string"
    )
    found = {
        (r["doc_id"], r["token"]): round(r["tf_idf"], 6)
        for r in textmining.tf_idf(docs, textmining.tokens(docs)).collect()
    }
    assert found[(1, "a")] == 0.120412 and found[(1, "sample")] == 0.060206
    assert found[(2, "another")] == 0.086009 and found[(2, "example")] == 0.129013
    assert found[(1, "this")] == found[(2, "is")] == 0.0


def test_empty_documents_count_for_idf(spark):
    docs = spark.createDataFrame([(1, "rock"), (2, "")], "doc_id long, text string")
    row = textmining.tf_idf(docs, textmining.tokens(docs)).first()
    assert math.isclose(row["idf"], math.log10(2))


def test_title_key(spark):
    assert values(spark, titles.title_key, ["Road Trip", "Chill", "", None, "  A  b "]) == [
        "road_trip", "chill", "", None, "a_b",
    ]


def test_squeeze_and_punctuation(spark):
    assert values(spark, titles.squeeze_spaced, ["p l a y", "a b", "road trip"]) == ["play", "ab", "road trip"]
    assert values(spark, titles.strip_punct, ["rock&roll!", "old_school"]) == ["rockroll", "old school"]


def test_title_tokens(spark):
    slang, emoji = [("hw", ["home", "work"])], [("😍", ["love"])]
    found = values(spark, lambda v: titles.title_tokens(v, slang, emoji), ["My😍 Playlist", "hw time", None])
    assert found[0] == ["my", "love"]
    assert found[1] == ["home", "work", "time"]


def test_slang_left_after_replacement_is_extended(spark):
    found = values(spark, lambda v: titles.title_tokens(v, [("h-w", ["x"]), ("hw", ["home"])], []), ["h_w"])
    assert found[0] == ["h w"]


def test_hours_label(spark):
    assert values(spark, titles.hours_label, [3_600_000 * 2 + 420_000], "long") == ["2h 7m"]


def test_words_and_html(spark):
    assert values(spark, lambda v: words(v, ["the"]), ["The Été, rock_1!"]) == [["été", "rock_1"]]
    assert values(spark, clean_html, ["A&amp;B &eacute;", None]) == ["a&b é", None]


def test_emoji_profile_and_lookup(spark):
    docs = spark.createDataFrame([(1, "love 😍😍"), (2, "😴"), (3, "none 🚗")], "doc_id long, text string")
    found = {r["token"]: (r["n"], r["docs"]) for r in textmining.symbol_profile(docs, EMOJI).collect()}
    assert found == {"😍": (2, 1), "😴": (1, 1)}
    index = textmining.inverted_index(textmining.symbols(docs))
    assert [r["doc_id"] for r in textmining.rows_with_symbol(docs, index, "😍").collect()] == [1]


def test_seed_buckets_with_remainder(spark):
    lists = spark.createDataFrame([(i, "test", i + 1) for i in range(13)], "pid long, part string, num_tracks long")
    found = split.seed_buckets(lists).groupBy("k").count().collect()
    assert sorted((r[0], r[1]) for r in found) == [(0, 2), (1, 2), (5, 2), (10, 2), (25, 2), (100, 3)]
    shortest = split.seed_buckets(lists).where("k = 0").agg(F.max("num_tracks")).first()[0]
    assert shortest == 2


def test_fewer_lists_than_buckets(spark):
    lists = spark.createDataFrame([(1, "test", 3), (2, "test", 4)], "pid long, part string, num_tracks long")
    assert {r["k"] for r in split.seed_buckets(lists).collect()} == {100}


def test_playlist_windows(spark):
    rows = entries(spark, {1: list("12345"), 2: list("123")})
    found = segments.playlist_windows(rows, 3, "track_uri").collect()
    assert sorted((r["start"], "".join(r["x"]), "".join(r["y"])) for r in found) == [(0, "123", "234"), (1, "234", "345")]


def test_windows_without_unknown_items(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([5, 1, 6, 7])], "pid long, pos long, item_id long")
    found = segments.playlist_windows(rows, 2, drop_item=1).collect()
    assert [(r["x"], r["y"]) for r in found] == [([5, 6], [6, 7])]


def test_corpus_windows(spark):
    rows = spark.range(10).select(F.col("id").alias("offset"), F.col("id").alias("item_id"))
    found = segments.corpus_windows(rows, 3, 5).collect()
    assert sorted((r["start"], r["x"], r["y"]) for r in found) == [(0, [0, 1, 2], [1, 2, 3]), (5, [5, 6, 7], [6, 7, 8])]


def test_window_counts_do_not_go_negative(spark):
    lists = spark.createDataFrame([(1, 2), (2, 10)], "pid long, num_tracks long")
    row = vocab.window_counts(lists, 5, 2, 4).first()
    assert (row["playlist_windows"], row["playlist_steps"]) == (5, 2)


def test_interleave(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 0, 3, "c"), (1, 1, 1, "b"), (1, 1, 2, "d"), (1, 1, 3, "e")]
    lists = spark.createDataFrame(rows, "pid long, list_no int, rank int, item string")
    found = ranking.interleave(lists, "pid", "item", 4).orderBy("rank").collect()
    assert [r["item"] for r in found] == ["a", "b", "d", "c"]


def test_artist_cap_and_own_artist(spark):
    similar = spark.createDataFrame(
        [("s", i + 1, f"i{i}", 1.0 - i / 10) for i in range(6)], "seed string, rank int, item string, similarity double"
    )
    artists = spark.createDataFrame(
        [("s", "own")] + [(f"i{i}", a) for i, a in enumerate(["x", "x", "x", "x", "y", "own"])], "item string, artist string"
    )
    found = item_vectors.diversify(similar, artists).orderBy("rank").collect()
    assert [r["item"] for r in found] == ["i0", "i1", "i2", "i4"]
    own = item_vectors.diversify(similar, artists, diff_artist=False).orderBy("rank").collect()
    assert [r["item"] for r in own][-1] == "i5"


def test_covering_sample_equals_sequential_pass(spark):
    import random

    rng = random.Random(2)
    lists = {p: [str(rng.randrange(30)) for _ in range(4)] for p in range(40)}
    wanted = {str(i) for i in range(0, 30, 2)}
    left, taken = set(wanted), []
    for pid in sorted(lists):
        new = left & set(lists[pid])
        if new:
            left -= new
            taken.append(pid)
    train = entries(spark, lists)
    want = spark.createDataFrame([(w,) for w in wanted], "track_uri string")
    found = split.covering_sample(train, want, 0.5, 1)
    assert sorted(r["pid"] for r in found.where("reason = 'cover'").collect()) == taken
    assert found.count() == max(20, len(taken))


def test_small_cover(spark):
    train = entries(spark, {1: ["a"], 2: ["a", "b"], 3: ["b"]})
    want = spark.createDataFrame([("a",), ("b",)], "track_uri string")
    assert sorted(r["pid"] for r in split.covering_sample(train, want, 0.0, 1).collect()) == [1, 2]


def test_walk_stops_after_enough_tracks(spark):
    near = spark.createDataFrame(
        [(9, 1, 1, 0.0), (9, 2, 2, 1.0), (9, 3, 3, 1.0)], "pid long, rank int, candidate long, distance double"
    )
    tracks = entries(spark, {1: ["a", "b"], 2: ["b", "c"], 3: ["d", "d", "d"]})
    found = title_match.vote_by_title(near, tracks, 3).orderBy("rank").collect()
    assert [(r["track_uri"], r["score"]) for r in found] == [("b", 2.0), ("a", 1.0), ("c", 1.0)]


def test_many_ties_all_vote(spark):
    near = spark.createDataFrame([(9, i + 1, i, 2.0) for i in range(101)], "pid long, rank int, candidate long, distance double")
    tracks = entries(spark, {i: ["a", f"x{i:03d}"] for i in range(101)})
    found = title_match.vote_by_title(near, tracks, 2).orderBy("rank").collect()
    assert [(r["track_uri"], r["score"]) for r in found] == [("a", 100.0), ("x000", 1.0)]


def test_walk_goes_on_behind_a_hundred_lists(spark):
    train = spark.createDataFrame([(i, "a" * (1 + i // 50)) for i in range(600)], "pid long, name string")
    lists = spark.createDataFrame([(900, "a", 0), (901, None, 0), (902, "a" * 12, 0)], "pid long, name string, k int")
    tracks = entries(spark, {i: [f"x{i // 2:03d}"] for i in range(600)})
    found = title_match.title_recommend(lists, train, tracks, 250).groupBy("pid").count().collect()
    assert {r["pid"]: r["count"] for r in found} == {900: 250, 902: 250}


def test_distances_belong_to_their_own_title(spark):
    schema = "pid long, name string"
    lists = spark.createDataFrame([(1, "rock"), (2, "jazz")], schema)
    train = spark.createDataFrame([(10, "rocks"), (11, "jazzy"), (12, None)], schema)
    found = title_match.nearest_titles(lists, train, 1).collect()
    assert sorted((r["pid"], r["candidate"], r["distance"]) for r in found) == [(1, 10, 1.0), (2, 11, 1.0)]


def test_title_vectors_and_missing_words(spark):
    names = spark.createDataFrame([("rock on",), ("rock",), ("zzz",)], "name string")
    known = spark.createDataFrame([("rock", [1.0, 3.0]), ("on", [3.0, 1.0])], "token string, vec array<double>")
    found = {r["name"]: r["vec"] for r in title_vectors.title_vectors(names, known, [], []).collect()}
    assert found == {"rock on": [2.0, 2.0], "rock": [1.0, 3.0]}


def test_fill_seeds_takes_vectors_first(spark):
    lists = spark.createDataFrame([(1, 0), (2, 0), (3, 5)], "pid long, k int")
    schema = "pid long, rank int, track_uri string, score double"
    by_vector = spark.createDataFrame([(1, 1, "v", 1.0), (3, 1, "v", 1.0)], schema)
    by_title = spark.createDataFrame([(1, 1, "t", 1.0), (2, 1, "t", 1.0)], schema)
    found = title_vectors.fill_seeds(lists, by_vector, by_title).collect()
    assert sorted((r["pid"], r["track_uri"], r["source"]) for r in found) == [(1, "v", "vector"), (2, "t", "title")]


def test_continuations(spark):
    train = entries(spark, {1: ["a", "b", "c"], 2: ["a", "b"], 3: ["a", "c"]})
    fitted = transitions.fit_transitions(train)
    seeds = entries(spark, {9: ["a", "zz"]})
    full = {r["track_uri"]: round(r["score"], 6) for r in transitions.continue_full(seeds, fitted).collect()}
    assert full == {"b": 0.666667, "c": 0.333333}
    semi = {r["track_uri"]: round(r["score"], 6) for r in transitions.continue_semi(seeds, fitted).collect()}
    assert semi == {"b": 0.333333, "c": 0.666667}
    assert transitions.next_item(entries(spark, {9: ["a"]}), fitted).first()["next"] == "b"


def test_vocabulary_round_trip(spark):
    lists = entries(spark, {1: ["a", "b", "a"], 2: ["c", "a", "b"]})
    keep = spark.createDataFrame([("c",)], "track_uri string")
    small = vocab.prune_vocab(vocab.build_vocab(lists), keep, 1, lists)
    ids = {r["track_uri"]: (r["item_id"], r["freq"]) for r in small.collect()}
    assert ids["<eos>"] == (0, 2) and ids["<unk>"] == (1, 0) and ids["a"] == (2, 3) and ids["c"][0] == 4
    back = vocab.decode(vocab.encode(lists, small), small)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lists.collect()))
    unknown = vocab.encode(entries(spark, {3: ["a", "new"]}), small, unknown="map")
    assert sorted(r["item_id"] for r in unknown.collect()) == [1, 2]
    assert vocab.encode(entries(spark, {3: ["a", "new"]}), small).count() == 1


def test_slice_files(spark, tmp_path):
    track = lambda i: {"pos": i, "track_uri": f"t{i}", "track_name": "n", "artist_uri": "a", "duration_ms": 5}
    doc = {
        "info": {"slice": "0-999", "version": "v1", "generated_on": "now"},
        "playlists": [
            {"pid": 0, "name": "x", "collaborative": "false", "num_tracks": 2, "tracks": [track(0), track(1)]},
            {"pid": 1, "name": "y", "description": "d", "collaborative": True, "num_tracks": 0, "tracks": []},
        ],
    }
    (tmp_path / "mpd.slice.0-999.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "other.json").write_text("{}")
    found = slices.read_slices(spark, str(tmp_path))
    assert {r["pid"]: (r["collaborative"], r["description"]) for r in found.collect()} == {0: (False, None), 1: (True, "d")}
    rows = lookups.explode_tracks(found)
    assert [(r["pid"], r["pos"], r["track_uri"]) for r in rows.orderBy("pos").collect()] == [(0, 0, "t0"), (0, 1, "t1")]
    seeds = slices.read_challenge_set(spark, str(tmp_path)).where("pid is not null")
    assert sorted(len(r["tracks"]) for r in seeds.collect()) == [0, 2]


def test_slice_lookup(spark):
    row = lookups.lookup_playlists(entries(spark, {12009: ["a"], 1_000_001: ["b"]}), [12009, 1_000_001, 7, -1]).collect()
    assert sorted((r["slice"], r["idx"]) for r in row) == [(12000, 9), (1_000_000, 1)]


def test_rec_file_keeps_the_last_line(spark, tmp_path):
    text = "team_info,main,me,mail\n1, a, b\n\n2, c\n\n1, x, y\n\n"
    (tmp_path / "recs.csv").write_text(text)
    found = recfiles.read_recs(spark, str(tmp_path / "recs.csv")).orderBy("pid", "rank").collect()
    assert [tuple(r) for r in found] == [(1, 1, "x"), (1, 2, "y"), (2, 1, "c")]
    lists = spark.createDataFrame([(1,), (3,)], "pid long")
    left = recfiles.pending(lists, recfiles.read_recs(spark, str(tmp_path / "recs.csv")))
    assert [r["pid"] for r in left.collect()] == [3]


def test_replacement_dict_is_checked(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"key":"hw","tokens":["home","work"]}\n{"key":"a","tokens":["b"]}\n')
    assert stored_tables.read_replacement_dict(spark, str(tmp_path / "d.json")) == [("a", ["b"]), ("hw", ["home", "work"])]
    with pytest.raises(ValueError):
        stored_tables.read_replacement_dict(spark, str(tmp_path / "d.json"), limit=1)


def test_word_vectors_text(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\nrock 1 2 3\npop 0.5 0 1\n")
    found = {r["token"]: r["vec"] for r in stored_tables.read_word_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert found == {"rock": [1.0, 2.0, 3.0], "pop": [0.5, 0.0, 1.0]}


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 2, 3, 10, 10]], "x int")
    found = [r["n"] for r in profile.histogram(df, "x", 5).orderBy("bin").collect()]
    assert found == [2, 2, 0, 0, 2]


def test_sparse_bins_lose_their_edge(spark):
    df = spark.createDataFrame([(v,) for v in [0, 0, 0, 1, 1, 1, 9]], "x int")
    edges = [r["edge"] for r in binning.equal_width_edges(df, "x", 3).orderBy("idx").collect()]
    assert edges == [0.0, 9.0]


def test_split_is_stratified_where_possible(spark):
    rows = spark.range(100).select(F.col("id").alias("pid"), (F.col("id") % 4).alias("c"))
    found = split.stratified_split(rows, ["c"], 0.2, 1).join(rows, "pid").where("part = 'test'")
    assert {r["c"]: r["count"] for r in found.groupBy("c").count().collect()} == {0: 5, 1: 5, 2: 5, 3: 5}
    single = rows.withColumn("c", F.when(F.col("pid") == 0, 9).otherwise(F.col("c")))
    assert split.stratified_split(single, ["c"], 0.2, 1).where("part = 'test'").count() == 20


def test_small_strata_are_drawn_together(spark):
    n = F.col("id")
    rows = spark.range(400).select(n.alias("pid"), F.when(n < 100, n).when(n < 300, F.lit(-1)).alias("c"))
    found = split.stratified_split(rows, ["c"], 0.1, 1).join(rows, "pid").where("part = 'test'")
    kinds = found.groupBy(F.when(F.col("c") >= 0, "small").when(F.col("c") < 0, "large").otherwise("null").alias("s")).count()
    assert {r["s"]: r["count"] for r in kinds.collect()} == {"small": 10, "large": 20, "null": 10}
