"""Ranking, binning, splitting, sampling, vocabulary and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.tables import _CLASSES
from encore.operators import binning, profile, ranking, segments, sketches, split, vocab
from encore.functions.classes import edge_class
from encore.sources.star import EVAL_SEED, KS, SPLIT_SEED, BUCKET_SEED, TEST_SHARE

CLASSES = [f"{c}_class" for c in binning.STRATA]
LENGTH, STEP, BATCH = 10, 5, 32


@query(
    "e1_rank_by_length",
    "SELECT pid, num_tracks, row_number() OVER (ORDER BY num_tracks, md5('rank:' || pid), pid) AS rank FROM plist",
)
def _(s):
    rows = s.playlists.select("pid", "num_tracks", ranking.hash_order("rank", "pid").alias("h"))
    rows = rows.withColumn("b", ranking.hash_block(F.col("h")))
    return ranking.split_rank(rows, ["h", "pid"], "rank", [], ["num_tracks", "b"]).drop("h", "b")


@query(
    "e2_grouped_top_k",
    """SELECT artist_uri, track_uri, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY artist_uri
       ORDER BY n DESC, track_uri) AS rank FROM (SELECT artist_uri, track_uri, count(*) AS n FROM e_tracks GROUP BY ALL))
       WHERE rank <= 5""",
)
def _(s):
    counts = s.tracks.groupBy("artist_uri", "track_uri").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_k_per(counts, ["artist_uri"], [F.desc("n"), "track_uri"], 5)


@query(
    "e3_artist_cap",
    """SELECT pid, artist_uri, pos, track_uri FROM (SELECT *, row_number() OVER (PARTITION BY pid, artist_uri ORDER BY pos)
       AS r FROM e_tracks) WHERE r <= 2""",
)
def _(s):
    rows = s.tracks.select("pid", "artist_uri", "pos", "track_uri")
    return ranking.cap_per(rows, ["pid"], "artist_uri", ["pos"], 2)


@query(
    "e4_interleave",
    """SELECT pid, rank, track_uri FROM (SELECT pid, track_uri, row_number() OVER (PARTITION BY pid ORDER BY r, l) AS rank
       FROM (SELECT pid, track_uri, min(r) AS r, arg_min(l, r * 1000000 + l) AS l FROM (
         SELECT pid, track_uri, order_id AS l, row_number() OVER (PARTITION BY order_id ORDER BY pos) AS r FROM e_tracks)
         GROUP BY ALL)) WHERE rank <= 20""",
)
def _(s):
    place = ranking.split_rank(
        s.tracks.select("pid", "track_uri", "order_id", "pos").withColumn("b", F.floor(F.col("pos") / 1024)),
        ["pos"], "rank", ["order_id"], ["b"],
    )
    lists = place.select("pid", "rank", F.col("order_id").alias("list_no"), "track_uri")
    return ranking.interleave(lists, "pid", "track_uri", 20)


@query(
    "e5_accumulate",
    """SELECT pid, edited_at, count(*) AS n FROM e_tracks e WHERE edited_at <= (
         SELECT coalesce(min(edited_at), 9e18) FROM (
           SELECT pid, edited_at, sum(news) OVER (PARTITION BY pid ORDER BY edited_at) AS have FROM (
             SELECT pid, edited_at, count(*) AS news FROM (
               SELECT pid, track_uri, min(edited_at) AS edited_at FROM e_tracks GROUP BY ALL) GROUP BY ALL)) h
         WHERE h.pid = e.pid AND have >= 12) GROUP BY ALL""",
)
def _(s):
    rows = s.tracks.select("pid", "edited_at", "track_uri")
    return (
        ranking.accumulate_until(rows, "pid", "edited_at", "track_uri", 12)
        .groupBy("pid", "edited_at").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "e6_first_hit",
    "SELECT pid, coalesce(min(pos) FILTER (WHERE artist_uri = 'Brand#1'), -1) AS first_hit FROM e_tracks GROUP BY pid",
)
def _(s):
    rows = ranking.first_hit(s.tracks.withColumn("hit", F.col("artist_uri") == "Brand#1"), "pid", "pos")
    return rows.withColumn("first_hit", F.coalesce("first_hit", F.lit(-1)))


@query(
    "e7_ordered_distinct",
    """SELECT pid, artist_uri, row_number() OVER (PARTITION BY pid ORDER BY p) AS pos FROM (
       SELECT pid, artist_uri, min(pos) AS p FROM e_tracks GROUP BY ALL)""",
)
def _(s):
    return ranking.ordered_distinct(s.tracks.select("pid", "artist_uri", "pos"), "pid", "artist_uri", "pos")


@query(
    "e8_next_item",
    """SELECT pid, prev, next, count(*) AS n FROM (SELECT pid, track_uri AS prev,
       lead(track_uri) OVER (PARTITION BY pid ORDER BY pos) AS next FROM e_tracks) WHERE next IS NOT NULL GROUP BY ALL""",
)
def _(s):
    return segments.next_items(s.tracks).groupBy("pid", "prev", "next").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e9_distribution",
    "SELECT popularity, count(*) AS n FROM pop GROUP BY popularity ORDER BY popularity DESC",
)
def _(s):
    return (
        profile.popularity(s.tracks).groupBy("popularity").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("popularity"))
    )


@query(
    "e10_union_interactions",
    "SELECT pid, track_uri FROM train_tracks UNION SELECT pid, track_uri FROM seeds",
)
def _(s):
    return s.train.select("pid", "track_uri").unionByName(s.seeds.select("pid", "track_uri")).distinct()


@query(
    "e11_intersect",
    "SELECT pid, track_uri FROM seeds INTERSECT SELECT pid, track_uri FROM truth",
)
def _(s):
    return s.seeds.select("pid", "track_uri").intersect(s.truth.select("pid", "track_uri"))


@query("e12_except", "SELECT pid FROM plist EXCEPT SELECT pid FROM first_split WHERE part = 'test'")
def _(s):
    return s.playlists.select("pid").exceptAll(s.first_split.where("part = 'test'").select("pid"))


@query("e13_eval_tracks", "SELECT track_uri FROM inclusion")
def _(s):
    return split.eval_tracks(s.part_tracks.where("part <> 'train'"))


@query(
    "f1_quantile_edges",
    """SELECT bins, round(edge, 6) AS edge FROM (SELECT DISTINCT 10 AS bins, edge FROM q_edges WHERE feature = 'num_tracks'
       UNION ALL SELECT DISTINCT 21, unnest(quantile_cont(CAST(num_tracks AS DOUBLE), list_transform(range(1, 22), lambda i: i / 21)))
       FROM plist)""",
)
def _(s):
    parts = [
        binning.quantile_edges(s.playlists, "num_tracks", b).select(F.lit(b).alias("bins"), "edge") for b in (10, 21)
    ]
    return rounded(parts[0].unionByName(parts[1]), "edge")


@query(
    "f1_quantile_edges_sketched",
    """SELECT i / 10 AS prob, count(num_tracks) AS n, true AS within FROM plist, (SELECT unnest(range(1, 11)) AS i) GROUP BY i""",
)
def _(s):
    """Deciles from one stored sketch per 16th of the playlists, and whether they keep their rank error."""
    error, parted = 0.005, s.playlists.select("num_tracks", F.pmod(F.xxhash64("pid"), F.lit(16)).alias("part"))
    parts = s.stored("track_sketches", lambda: sketches.quantile_sketches(parted, "num_tracks", ["part"], error))
    found = sketches.merged_quantiles(parts, [i / 10 for i in range(1, 11)])
    tenths = found.agg(F.collect_list(F.struct("prob", "value"))).scalar()  # ten entries
    exact = s.playlists.select(F.col("num_tracks").cast("double").alias("x"), F.inline(tenths)).where("x is not null")
    ranks = exact.groupBy("prob").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto")
    )
    slack = error * F.col("n") + 1
    within = (F.col("below") <= F.col("prob") * F.col("n") + slack) & (F.col("upto") >= F.col("prob") * F.col("n") - slack)
    return ranks.select("prob", "n", within.alias("within"))


@query("f2_quantile_class", "SELECT pid, num_tracks, num_tracks_class FROM strata")
def _(s):
    return binning.with_quantile_class(s.playlists, ["num_tracks"]).select(
        "pid", "num_tracks", F.col("num_tracks_class").cast("long")
    )


@query("f3_stratification_classes", f"SELECT pid, {_CLASSES} FROM strata")
def _(s):
    return binning.stratification_classes(s.playlists).select(
        "pid", *[F.col(c).cast("long").alias(c) for c in CLASSES]
    )


_KEPT = """
    SELECT row_number() OVER (ORDER BY b) - 1 AS idx, edge FROM (
      SELECT b, lo + b * (hi - lo) / 21 AS edge,
        (SELECT count(*) FROM plist WHERE least(floor((num_tracks - lo) / ((hi - lo) / 21)), 20) = b) AS n
      FROM range(22) t(b), (SELECT CAST(min(num_tracks) AS DOUBLE) AS lo, CAST(max(num_tracks) AS DOUBLE) AS hi FROM plist))
    WHERE n >= 3 OR b = 21"""


@query("f4_equal_width_edges", f"SELECT CAST(idx AS INTEGER) AS idx, round(edge, 6) AS edge FROM ({_KEPT})")
def _(s):
    return rounded(binning.equal_width_edges(s.playlists, "num_tracks", 21), "edge")


@query(
    "f5_edge_class",
    f"""SELECT pid, num_tracks, greatest(0, (SELECT count(*) FROM ({_KEPT}) WHERE round(edge, 6) <= num_tracks) - 1) AS class
        FROM plist""",
)
def _(s):
    edges = rounded(binning.equal_width_edges(s.playlists, "num_tracks", 21), "edge")
    rows = s.playlists.select("pid", "num_tracks", binning.edges_array(edges).scalar().alias("e"))
    return rows.select("pid", "num_tracks", edge_class(F.col("num_tracks"), F.col("e")).cast("long").alias("class"))


@query(
    "f6_freedman_diaconis",
    """SELECT n, round(w, 6) AS width, CAST(ceil(w) AS BIGINT) AS rule, CAST(ceil((hi - lo) / w) AS BIGINT) AS bins FROM (
       SELECT count(x) AS n, max(x) AS hi, min(x) AS lo,
         2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / cbrt(count(x)) AS w
       FROM (SELECT CAST(num_tracks AS DOUBLE) AS x FROM plist))""",
)
def _(s):
    return rounded(binning.freedman_diaconis(s.playlists, "num_tracks"), "width")


@query(
    "f7_doane",
    """SELECT n, round(g1, 6) AS g1, round(sigma, 6) AS sigma,
         CAST(ceil(1 + log2(n) + log2(1 + abs(g1) / sigma)) AS BIGINT) AS bins FROM (
       SELECT count(*) AS n, (avg(power(x, 3)) - 3 * avg(x) * avg(power(x, 2)) + 2 * power(avg(x), 3)) / power(var_pop(x), 1.5) AS g1,
         sqrt(6.0 * (count(*) - 2) / ((count(*) + 1.0) * (count(*) + 3))) AS sigma
       FROM (SELECT CAST(num_tracks AS DOUBLE) AS x FROM plist))""",
)
def _(s):
    return rounded(binning.doane(s.playlists, "num_tracks"), "g1", "sigma")


@query(
    "f8_rare_strata",
    f"SELECT {_CLASSES}, count(*) AS n FROM strata GROUP BY ALL HAVING count(*) < 3",
)
def _(s):
    rows = s.strata.select(*[F.col(c).cast("long").alias(c) for c in CLASSES])
    return binning.rare_strata(rows, CLASSES)


@query(
    "f8_rows_of_rare_strata",
    f"SELECT pid FROM strata WHERE ({_CLASSES}) IN (SELECT ({_CLASSES}) FROM strata GROUP BY {_CLASSES} HAVING count(*) < 3)",
)
def _(s):
    return binning.rows_of_rare_strata(s.strata, CLASSES).select("pid")


@query(
    "f9_stratified_split",
    f"""SELECT pid, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('{SPLIT_SEED}:' || pid), pid)
          <= floor(count(*) OVER (PARTITION BY stratum) * 0.1 + 0.5) THEN 'test' ELSE 'train' END AS part
        FROM (SELECT pid, CASE WHEN count(*) OVER (PARTITION BY num_tracks_class) >= 5 THEN num_tracks_class END AS stratum
          FROM strata)""",
)
def _(s):
    return split.stratified_split(s.strata, ["num_tracks_class"], TEST_SHARE, SPLIT_SEED)


@query("f9_small_strata_split", "SELECT pid, part FROM first_split")
def _(s):
    return split.stratified_split(s.strata, CLASSES, TEST_SHARE, SPLIT_SEED)


_RARE_TEST = "SELECT e.* FROM rare_tracks e JOIN first_split USING (pid) WHERE part = 'test'"
_RARE_TRAIN = "SELECT e.* FROM rare_tracks e JOIN first_split USING (pid) WHERE part = 'train'"


@query(
    "f10_missing_tracks",
    f"""SELECT pid, count(*) AS missing FROM ({_RARE_TEST}) WHERE track_uri NOT IN (
        SELECT track_uri FROM ({_RARE_TRAIN})) GROUP BY pid""",
)
def _(s):
    return split.missing_tracks(*s._parts(s.rare_tracks))


@query(
    "f10_covered_candidates",
    f"""SELECT DISTINCT pid FROM ({_RARE_TEST}) WHERE pid NOT IN (SELECT pid FROM ({_RARE_TEST}) WHERE track_uri NOT IN (
        SELECT track_uri FROM ({_RARE_TRAIN})))""",
)
def _(s):
    return split.covered_candidates(*s._parts(s.rare_tracks))


@query("f11_draw_eval", "SELECT pid, part FROM drawn")
def _(s):
    return split.draw_eval(s.parts.where("part <> 'train'"), EVAL_SEED)


@query("f12_train_rest", "SELECT pid FROM parts WHERE part = 'train'")
def _(s):
    return split.train_rest(s.playlists, s.parts.where("part <> 'train'").select("pid"))


@query("f13_seed_buckets", "SELECT pid, part, k FROM lists")
def _(s):
    rows = split.seed_buckets(s.parts.where("part <> 'train'"), KS, BUCKET_SEED)
    return rows.select("pid", "part", "k")


@query(
    "f14_seed_truth",
    "SELECT pid, k, count(*) FILTER (WHERE is_seed) AS seeds, count(*) FILTER (WHERE NOT is_seed) AS hidden, "
    "coalesce(string_agg(track_uri, ' ' ORDER BY pos) FILTER (WHERE is_seed), '') AS seed FROM part_tracks "
    "WHERE part <> 'train' GROUP BY ALL",
)
def _(s):
    keyed = s.lists.select("pid", "k", "num_tracks")
    rows = split.seed_truth(split.assign(s.tracks.select("pid", "pos", "track_uri"), keyed))
    shown = F.array_sort(F.collect_list(F.when(F.col("is_seed"), F.struct("pos", "track_uri"))))
    return rows.groupBy("pid", "k").agg(
        F.count_if("is_seed").alias("seeds"),
        F.count_if(~F.col("is_seed")).alias("hidden"),
        F.array_join(F.transform(shown, lambda c: c["track_uri"]), " ").alias("seed"),
    )


@query(
    "f15_covering_sample",
    """SELECT pid, 'cover' AS reason FROM cover UNION ALL SELECT pid, 'fill' FROM (
       SELECT pid, row_number() OVER (ORDER BY md5('7:' || pid), pid) AS r FROM train_lists WHERE pid NOT IN (SELECT pid FROM cover))
       WHERE r <= floor((SELECT count(*) FROM train_lists) * 0.9) - (SELECT count(*) FROM cover)""",
)
def _(s):
    wanted = split.eval_tracks(s.part_tracks.where("part <> 'train'"))
    return split.covering_sample(s.train, wanted, 0.9, 7)


@query("f17_train_playlists", "SELECT pid, pos, track_uri FROM train_tracks")
def _(s):
    rows = s.tracks.select("pid", "pos", "track_uri")
    return split.assign(rows, s.parts.where("part = 'train'").select("pid", "num_tracks"))


def _vocab(s):
    return vocab.prune_vocab(
        vocab.build_vocab(s.train), split.eval_tracks(s.part_tracks.where("part <> 'train'")), 5, s.train
    )


def _encoded(s):
    return s.stored("encoded", lambda: vocab.encode(vocab.append_eos(s.train), _vocab(s)))


def _dense(s):
    return s.stored("dense", lambda: segments.dense_positions(_encoded(s), "item_id"))


@query(
    "g1_build_vocab",
    "SELECT track_uri, row_number() OVER (ORDER BY freq DESC, md5('vocab:' || track_uri), track_uri) - 1 AS item_id, freq "
    "FROM train_pop",
)
def _(s):
    return vocab.build_vocab(s.train)


@query("g2_prune_vocab", "SELECT track_uri, item_id, freq FROM full_vocab")
def _(s):
    return _vocab(s)


@query(
    "g2_prune_vocab_rare",
    """SELECT track_uri, row_number() OVER (ORDER BY freq DESC, md5('vocab:' || track_uri), track_uri) + 1 AS item_id, freq FROM (
       SELECT track_uri, count(*) AS freq FROM rare_tracks GROUP BY ALL HAVING count(*) > 5) UNION ALL
       SELECT unnest(['<eos>', '<unk>']), unnest([0, 1]), 0""",
)
def _(s):
    none = s.rare_tracks.select("track_uri").limit(0)
    return vocab.prune_vocab(vocab.build_vocab(s.rare_tracks), none, 5)


@query("g3_encode", "SELECT pid, pos, item_id FROM train_tracks JOIN full_vocab USING (track_uri)")
def _(s):
    return vocab.encode(s.train, _vocab(s))


@query(
    "g3_encode_unknown",
    """SELECT pid, pos, coalesce(item_id, 1) AS item_id FROM rare_tracks LEFT JOIN (
       SELECT track_uri, row_number() OVER (ORDER BY freq DESC, md5('vocab:' || track_uri), track_uri) + 1 AS item_id FROM (
       SELECT track_uri, count(*) AS freq FROM rare_tracks GROUP BY ALL HAVING count(*) > 5)) USING (track_uri)""",
)
def _(s):
    none = s.rare_tracks.select("track_uri").limit(0)
    small = vocab.prune_vocab(vocab.build_vocab(s.rare_tracks), none, 5)
    return vocab.encode(s.rare_tracks, small, unknown="map")


@query("g4_append_eos", "SELECT pid, pos, track_uri FROM marked")
def _(s):
    return vocab.append_eos(s.train)


@query(
    "g5_corpus_windows",
    f"""SELECT a.i AS start, string_agg(b.item_id, ' ' ORDER BY b.i) FILTER (WHERE b.i < a.i + {LENGTH}) AS x,
          string_agg(b.item_id, ' ' ORDER BY b.i) FILTER (WHERE b.i > a.i) AS y
        FROM corpus a JOIN corpus b ON b.i BETWEEN a.i AND a.i + {LENGTH}
        WHERE a.i % {STEP} = 0 AND a.i + {LENGTH} < (SELECT count(*) FROM corpus) GROUP BY a.i""",
)
def _(s):
    rows = segments.corpus_windows(vocab.corpus(_dense(s)), LENGTH, STEP)
    return rows.select("start", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


_INSIDE = f"""
    SELECT pid, start, x, y FROM (SELECT pid, pos AS start, count(*) OVER w AS n,
      string_agg(item_id, ' ') OVER (PARTITION BY pid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING) AS x,
      string_agg(item_id, ' ') OVER (PARTITION BY pid ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {LENGTH} FOLLOWING) AS y
      FROM (SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY pos) - 1 AS pos, item_id FROM encoded WHERE item_id <> 0)
      WINDOW w AS (PARTITION BY pid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LENGTH} FOLLOWING)) WHERE n = {LENGTH + 1}"""


@query("g6_playlist_windows", _INSIDE)
def _(s):
    rows = segments.playlist_windows(_encoded(s), LENGTH, drop_item=vocab.EOS_ID)
    return rows.select("pid", "start", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query(
    "g7_window_counts",
    f"""SELECT CAST(sum(num_tracks + 1) AS BIGINT) AS corpus_items,
          CAST(sum(greatest(num_tracks - {LENGTH}, 0)) AS BIGINT) AS playlist_windows,
          CAST((sum(num_tracks + 1) // {BATCH} - 1) // {STEP} AS BIGINT) AS corpus_steps,
          CAST(ceil(sum(greatest(num_tracks - {LENGTH}, 0)) / {BATCH}) AS BIGINT) AS playlist_steps FROM train_lists""",
)
def _(s):
    return vocab.window_counts(s.train_lists, LENGTH, STEP, BATCH)


@query(
    "g8_batches",
    f"""SELECT pid, start, (row_number() OVER (ORDER BY md5('5:' || pid || ':' || start), pid, start) - 1) // {BATCH} AS batch
        FROM ({_INSIDE})""",
)
def _(s):
    rows = segments.playlist_windows(_encoded(s), LENGTH, drop_item=vocab.EOS_ID).select("pid", "start")
    return vocab.batches(rows, BATCH, 5)


@query(
    "g3_decode",
    "SELECT pid, pos, track_uri FROM train_tracks WHERE track_uri IN (SELECT track_uri FROM full_vocab)",
)
def _(s):
    return vocab.decode(_encoded(s).where(F.col("item_id") != vocab.EOS_ID), _vocab(s))
