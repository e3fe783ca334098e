"""Title similarity, title vectors and seed approximation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from encore.functions import titles, vectors
from encore.operators import bounded_search, item_vectors, title_match, title_vectors
from encore.sources.star import EMOJI_TERMS, SLANG

SEED_K = 100


def near(s):
    return s.stored("near_titles", lambda: title_match.nearest_titles(s.test_lists, s.train_lists))


def name_vectors(s):
    return s.stored(
        "title_vectors", lambda: title_vectors.title_vectors(s.names, s.word_vectors, SLANG, EMOJI_TERMS)
    )


def similar(s):
    return s.stored(
        "similar_lists",
        lambda: title_vectors.similar_playlists(s.test_lists, s.train_lists, name_vectors(s)),
    )


def shown(rows):
    """Similarities as the statements show them; their order is that of the full values."""
    return rows.withColumn("similarity", F.round("similarity", 6))


@query("h1_title_key", "SELECT pid, key FROM train_keys")
def _(s):
    return s.train_lists.select("pid", titles.title_key(F.col("name")).alias("key"))


@query(
    "h2_title_distance",
    """SELECT q.key AS query, min(levenshtein(q.key, t.key)) AS distance
       FROM (SELECT DISTINCT key FROM test_keys) q, (SELECT DISTINCT key FROM train_keys) t GROUP BY q.key""",
)
def _(s):
    found = title_match.title_distance(s.test_lists, s.train_lists)
    return found.select("query", F.col("distance").cast("long").alias("distance"))


@query("c4_nearest_by_edit_distance", "SELECT pid, rank, candidate, CAST(distance AS BIGINT) AS distance FROM near_titles")
def _(s):
    rows = title_match.nearest_titles(s.test_lists, s.train_lists)
    return rows.withColumn("distance", F.col("distance").cast("long"))


@query("h3_nearest_titles", "SELECT pid, rank, candidate, CAST(distance AS BIGINT) AS distance FROM near_titles WHERE rank <= 10")
def _(s):
    rows = title_match.nearest_titles(s.test_lists, s.train_lists, 10)
    return rows.withColumn("distance", F.col("distance").cast("long"))


@query(
    "c6_candidate_tracks",
    """SELECT n.pid, n.rank, e.track_uri, count(*) AS n, min(pos) AS pos FROM near_titles n
       JOIN train_tracks e ON e.pid = n.candidate GROUP BY ALL""",
)
def _(s):
    return title_match.candidate_mentions(near(s), s.train, "distance").drop("distance")


def _vote_sql(k, where="true"):
    """Walk the nearest playlists until ``k`` distinct tracks, or let 100 tied ones vote."""
    return f"""
    SELECT pid, rank, track_uri, CAST(score AS DOUBLE) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, r, p, track_uri) AS rank FROM (
        SELECT pid, track_uri, count(*) AS score, min(rank) AS r, arg_min(pos, rank * 1000000 + pos) AS p
        FROM (SELECT n.pid, n.rank, e.track_uri, e.pos FROM all_titles n JOIN train_tracks e ON e.pid = n.candidate WHERE {where}) m
        LEFT JOIN (SELECT pid, coalesce(min(distance) = max(distance) FILTER (WHERE rank = 101), false) AS tied
          FROM near_titles GROUP BY pid) t USING (pid)
        LEFT JOIN (SELECT pid, min(rank) AS last FROM (
            SELECT pid, rank, sum(news) OVER (PARTITION BY pid ORDER BY rank) AS have FROM (
              SELECT pid, rank, count(*) AS news FROM (
                SELECT n.pid, e.track_uri, min(n.rank) AS rank FROM all_titles n JOIN train_tracks e ON e.pid = n.candidate
                GROUP BY ALL) GROUP BY ALL))
          WHERE have >= {k} GROUP BY pid) l USING (pid)
        WHERE CASE WHEN tied THEN rank <= 100 ELSE last IS NULL OR rank <= last END
        GROUP BY pid, track_uri))
    WHERE rank <= {k}"""


@query("h4_vote_by_title", _vote_sql(SEED_K))
def _(s):
    return title_match.title_recommend(s.test_lists, s.train_lists, s.train, SEED_K)


@query("h5_title_seeds", _vote_sql(SEED_K, "k = 0"))
def _(s):
    return title_match.title_seeds(s.test_lists, s.train_lists, s.train, SEED_K)


@query("h6_title_recommend", _vote_sql(500))
def _(s):
    return title_match.title_recommend(s.test_lists, s.train_lists, s.train, 500)


@query(
    "i1_replace_terms",
    """SELECT pid, replace(replace(replace(replace(replace(name, 'hm', 'homework'), 're', 'are here'), 'ou', 'or'),
       '😍', ' love'), 'th', ' the') AS name FROM names""",
)
def _(s):
    text = titles.replace_terms(F.col("name"), SLANG)
    return s.names.select("pid", titles.replace_terms(text, EMOJI_TERMS, " ").alias("name"))


@query(
    "i2_squeeze_spaced",
    """SELECT pid, CASE WHEN length(replace(t, ' ', '')) - 1 <= length(t) - length(replace(t, ' ', ''))
       THEN replace(t, ' ', '') ELSE t END AS t FROM (
       SELECT pid, trim(regexp_replace(name, '(.)', '\\1 ', 'g')) AS t FROM names
       UNION ALL SELECT pid + 1000000, name FROM names)""",
)
def _(s):
    spaced = F.trim(F.regexp_replace("name", "(.)", "$1 "))
    rows = s.names.select("pid", spaced.alias("t")).unionByName(
        s.names.select((F.col("pid") + 1000000).alias("pid"), F.col("name").alias("t"))
    )
    return rows.select("pid", titles.squeeze_spaced(F.col("t")).alias("t"))


@query(
    "i3_strip_punct",
    """SELECT page_id, trim(translate(url, '_!"#$%&''()*+,-./:;<=>?@[\\]^`{|}~', ' ')) AS token FROM pages""",
)
def _(s):
    return s.table("pages").select("page_id", titles.strip_punct(F.col("url")).alias("token"))


@query("i4_title_tokens", "SELECT name, token, count(*) AS n FROM title_tokens GROUP BY ALL")
def _(s):
    rows = s.names.select("name").distinct().select(
        "name", F.explode(titles.title_tokens(F.col("name"), SLANG, EMOJI_TERMS)).alias("token")
    )
    return rows.groupBy("name", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "i5_title_vector",
    """SELECT name, d, round(x, 6) + 0.0 AS x FROM (SELECT name, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS d
       FROM title_vectors)""",
)
def _(s):
    rows = title_vectors.title_vectors(s.names, s.word_vectors, SLANG, EMOJI_TERMS)
    parts = rounded(rows.select("name", F.posexplode("vec").alias("d", "x")), "x")
    return parts.select("name", F.col("d").cast("long").alias("d"), (F.col("x") + 0.0).alias("x"))  # no negative zero


@query("i6_vector_table", "SELECT pid, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS size "
       "FROM names JOIN title_vectors USING (name)")
def _(s):
    rows = title_vectors.vector_table(s.names, name_vectors(s))
    return rounded(rows.select("pid", vectors.norm("vec").alias("size")), "size")


@query(
    "i7_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(s):
    rows = s.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return rounded(rows.join(other, "vec_id").select("vec_id", vectors.cosine("a", "b").alias("cos")), "cos")


_SIMILAR = "SELECT pid, rank, candidate, round(similarity, 6) AS similarity FROM similar_lists WHERE rank <= 100"


@query("i8_similar_playlists", _SIMILAR)
def _(s):
    return shown(title_vectors.similar_playlists(s.test_lists, s.train_lists, name_vectors(s)))


@query("i9_batch_similar", f"{_SIMILAR} AND k = 0")
def _(s):
    return shown(title_vectors.similar_playlists(s.test_lists.where("k = 0"), s.train_lists, name_vectors(s)))


@query(
    "i8_similar_playlists_approx",
    "SELECT count(*) AS pairs, true AS enough, true AS exact FROM similar_lists WHERE rank <= 100 AND similarity >= 0.9",
)
def _(s):
    """Exact pairs of cosine 0.9 or more, whether 0.9 of them are found and every found one has its cosine."""
    exact = similar(s).where("rank <= 100 AND similarity >= 0.9").select("pid", "candidate", "similarity")
    found = title_vectors.similar_playlists_approx(s.test_lists, s.train_lists, name_vectors(s))
    both = exact.join(found.select("pid", "candidate", F.col("similarity").alias("mine")), ["pid", "candidate"], "left")
    return both.agg(
        F.count(F.lit(1)).alias("pairs"),
        (F.count("mine") >= 0.9 * F.count(F.lit(1))).alias("enough"),
        F.coalesce(F.max(F.abs(F.col("mine") - F.col("similarity"))) < 1e-9, F.lit(True)).alias("exact"),
    )


@query(
    "c5_nearest_by_cosine",
    """SELECT query, candidate, rank, similarity FROM (SELECT a.label AS query, b.vec_id AS candidate,
         round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity,
         row_number() OVER (PARTITION BY a.label ORDER BY round(list_cosine_similarity(a.vec, b.vec), 12) DESC, b.vec_id) AS rank
       FROM (SELECT label, list(x ORDER BY d) AS vec FROM (
           SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x,
             generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY ALL) GROUP BY label) a,
         (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings) b) WHERE rank <= 50""",
)
def _(s):
    base = title_vectors.unit(
        s.table("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    )
    means = (
        s.table("embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
        .groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
        .select(F.col("label").alias("query"), F.transform("v", lambda c: c["x"]).alias("item"))
    )
    found, _ = bounded_search.search(
        base.select(F.col("vec_id").alias("name"), F.col("vec_id").alias("tie"), F.col("vec").alias("item")),
        title_vectors.unit(means, "item"), 50,
    )
    return shown(found.select("query", F.col("name").alias("candidate"), "rank", (F.lit(0.0) - F.col("cost")).alias("similarity")))


def _similar_vote(k, where="true"):
    return f"""
    SELECT pid, rank, track_uri, round(CAST(score AS DOUBLE), 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, r, p, track_uri) AS rank FROM (
        SELECT l.pid, e.track_uri, sum(CAST(similarity AS DECIMAL(26, 12))) AS score, min(l.rank) AS r, arg_min(pos, l.rank * 1000000 + pos) AS p
        FROM similar_lists l JOIN train_tracks e ON e.pid = l.candidate WHERE {where} GROUP BY ALL))
    WHERE rank <= {k}"""


@query("i10_vote_by_similarity", _similar_vote(SEED_K, "l.rank <= 100"))
def _(s):
    return rounded(title_vectors.vote_by_similarity(similar(s), s.train, SEED_K), "score")


@query(
    "i11_fill_seeds",
    f"""SELECT pid, rank, track_uri, 'vector' AS source FROM ({_similar_vote(SEED_K, 'k = 0 AND l.rank <= 100')})
        UNION ALL SELECT pid, rank, track_uri, 'title' FROM ({_vote_sql(SEED_K, 'k = 0')})
        WHERE pid NOT IN (SELECT pid FROM similar_lists)""",
)
def _(s):
    cold = s.test_lists.where("k = 0").select("pid")
    by_vector = title_vectors.vote_by_similarity(similar(s).join(cold, "pid", "left_semi"), s.train, SEED_K)
    by_title = title_match.title_seeds(s.test_lists, s.train_lists, s.train, SEED_K)
    return title_vectors.fill_seeds(s.test_lists, by_vector, by_title)


def vector_recs(s):
    return s.stored(
        "vector_recs", lambda: title_vectors.vector_recommend(s.test_lists, s.train_lists, name_vectors(s), s.train, 500)
    )


@query("i12_vector_recommend", _similar_vote(500))
def _(s):
    return rounded(vector_recs(s), "score")


@query(
    "j1_playlist_documents",
    "SELECT pid, pos // 1024 AS segment, string_agg(track_uri, ' ' ORDER BY pos) AS document FROM train_tracks GROUP BY ALL",
)
def _(s):
    docs = item_vectors.playlist_documents(s.train)
    return docs.withColumn("document", F.array_join("document", " "))


@query("j3_similar_items", "SELECT seed, rank, item, round(similarity, 6) AS similarity FROM item_sims")
def _(s):
    items = s.item_seeds.select(F.col("track_uri").alias("item"))
    return shown(item_vectors.similar_items(s.item_vectors, items))


def item_lists(s):
    def build():
        items = s.item_seeds.select(F.col("track_uri").alias("item"))
        return item_vectors.diverse_items(s.item_vectors, items, s.item_vectors.select("item", "artist"))

    return s.stored("item_lists", build)


@query("j4_diversify", "SELECT seed, item, artist, round(similarity, 6) AS similarity, rank FROM item_lists")
def _(s):
    return shown(item_lists(s).select("seed", "item", "artist", "similarity", "rank"))


def _interleave_sql(with_seeds):
    own = (
        "UNION ALL SELECT pid, list_no, 0, seed FROM mine" if with_seeds else ""
    )
    return f"""
    SELECT pid, rank, track_uri FROM (
      SELECT pid, item AS track_uri, row_number() OVER (PARTITION BY pid ORDER BY r, l) AS rank FROM (
        SELECT pid, item, min(rank) AS r, arg_min(list_no, rank * 1000000 + list_no) AS l FROM (
          SELECT m.pid, m.list_no, i.rank, i.item FROM mine m JOIN item_lists i USING (seed)
          WHERE NOT EXISTS (SELECT 1 FROM mine o WHERE o.pid = m.pid AND o.seed = i.item) {own}) GROUP BY ALL))
    WHERE rank <= 500"""


@query("j5_interleave", _interleave_sql(False))
def _(s):
    return item_vectors.interleave_seeds(s.item_seeds, item_lists(s))


@query("j5_interleave_with_seeds", _interleave_sql(True))
def _(s):
    return item_vectors.interleave_seeds(s.item_seeds, item_lists(s), with_seeds=True)

