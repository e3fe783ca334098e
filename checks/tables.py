"""Shared SQL table expressions: the test tables as playlists."""

from __future__ import annotations

from encore.functions.titles import PUNCTUATION
from encore.operators.title_match import TIES
from encore.sources.star import EMOJI_TERMS, EVAL_SEED, KS, SLANG, SPLIT_SEED, BUCKET_SEED

_STRATA = ["num_tracks", "modified_at", "track_popularity_median"]
_TENTHS = "[" + ", ".join(str(i / 10) for i in range(1, 11)) + "]"
_CLASSES = ", ".join(f"{c}_class" for c in _STRATA)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _edges(column: str) -> str:
    return (
        f"SELECT DISTINCT {quoted(column)} AS feature, "
        f"unnest(quantile_cont(CAST({column} AS DOUBLE), {_TENTHS})) AS edge FROM plist"
    )


def _class(column: str) -> str:
    return (
        f"(SELECT count(*) FROM q_edges WHERE feature = {quoted(column)} AND edge < p.{column}) "
        f"AS {column}_class"
    )


def _replaced(text: str, terms, lead: str = "") -> str:
    for key, words in terms:
        text = f"replace({text}, {quoted(key)}, {quoted(lead + ' '.join(words))})"
    return text


def popularity_sql(key: str, counts: str, prefix: str) -> str:
    return (
        f"SELECT pid, CAST(sum(popularity) AS BIGINT) AS {prefix}_popularity_sum, "
        f"avg(popularity) AS {prefix}_popularity_mean, "
        f"median(CAST(popularity AS DOUBLE)) AS {prefix}_popularity_median, count(*) AS num_tracks "
        f"FROM e_tracks JOIN {counts} USING ({key}) GROUP BY pid"
    )


def transitions_sql(source: str) -> str:
    return (
        "SELECT prev, next, n, CAST(sum(n) OVER (PARTITION BY prev) AS BIGINT) AS total, "
        "n / sum(n) OVER (PARTITION BY prev) AS p FROM ("
        "SELECT prev, next, count(*) AS n FROM ("
        "SELECT track_uri AS prev, lead(track_uri) OVER (PARTITION BY pid ORDER BY pos) AS next "
        f"FROM {source}) WHERE next IS NOT NULL GROUP BY prev, next)"
    )


def semi_sql(hops: list[str]) -> str:
    """The 500 best continuations by weights of several hops that count alike."""
    weights = " UNION ALL ".join(f"SELECT pid, prev, weight FROM {h}" for h in hops)
    return f"""
        SELECT pid, rank, track_uri, CAST(score AS DOUBLE) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, track_uri) AS rank FROM (
            SELECT pid, next AS track_uri, sum(CAST(weight * p / {len(hops)} AS DECIMAL(26, 12))) AS score
            FROM ({weights}) JOIN transitions USING (prev) GROUP BY ALL) c
          WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.pid = c.pid AND s.track_uri = c.track_uri))
        WHERE rank <= 500"""


def metrics_sql(recs: str, truth: str, by: str = "") -> str:
    """Per-playlist metrics of ranked recommendations."""
    return f"""
    SELECT {by} pid, sum(hit * in_front) / any_value(n_truth) AS r_prec,
      sum(CASE WHEN hit = 1 AND first <= 500 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg,
      sum(CASE WHEN hit = 1 AND first <= 500 THEN 1 / log2(place + 1) ELSE 0 END)
        / any_value((SELECT sum(1 / log2(i + 1)) FROM range(1, n_ideal + 1) t(i))) AS ndcg,
      CAST(coalesce(min(CASE WHEN hit = 1 AND first <= 500 THEN (first - 1) // 10 END), 51) AS DOUBLE) AS clicks,
      sum(hit) / any_value(n_truth) AS recall
    FROM (
      SELECT {by} pid, track_uri, n_truth, n_ideal, first, in_front,
        CASE WHEN EXISTS (SELECT 1 FROM {truth} t WHERE t.pid = g.pid AND t.track_uri = g.track_uri)
          THEN 1 ELSE 0 END AS hit,
        row_number() OVER (PARTITION BY {by} pid ORDER BY CASE WHEN first <= 500 THEN first END NULLS LAST) AS place
      FROM (
        SELECT {by} r.pid, r.track_uri, n_truth, n_ideal, min(rank) AS first,
          count(*) FILTER (WHERE rank <= n_truth) AS in_front
        FROM {recs} r JOIN (
          SELECT pid, sum(m) AS n_truth, count(*) FILTER (WHERE first < 500) AS n_ideal FROM (
            SELECT pid, track_uri, count(*) AS m, min(pos) AS first FROM {truth} GROUP BY ALL)
          GROUP BY pid) s USING (pid)
        GROUP BY ALL) g)
    GROUP BY {by} pid"""


TABLES: dict[str, str] = {
    "e_tracks": """
        SELECT *, row_number() OVER (PARTITION BY pid
          ORDER BY edited_at, order_id, line_no, part_id, supplier_id, duration_ms) - 1 AS pos
        FROM (SELECT o_custkey AS pid, CAST(l_partkey AS VARCHAR) AS track_uri, p_name AS track_name,
            p_brand AS artist_uri, CAST(l_suppkey AS VARCHAR) AS album_uri,
            CAST(l_quantity * 1000 AS BIGINT) AS duration_ms,
            CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS edited_at,
            o_orderkey AS order_id, o_orderstatus = 'F' AS is_final,
            l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supplier_id
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "rare_tracks": """
        SELECT * REPLACE (track_uri || ':' || CAST(album_uri AS BIGINT) % 5 AS track_uri) FROM e_tracks""",
    "pop": "SELECT track_uri, count(*) AS popularity FROM e_tracks GROUP BY track_uri",
    "apop": "SELECT artist_uri, count(*) AS popularity FROM e_tracks GROUP BY artist_uri",
    "names": """
        SELECT pid, lower(replace(concat_ws(' ', track_name, artist_uri), '#', ' ')) AS name FROM e_tracks WHERE pos = 0""",
    "track_feats": popularity_sql("track_uri", "pop", "track"),
    "artist_feats": popularity_sql("artist_uri", "apop", "artist"),
    "plist": """
        SELECT * FROM (
          SELECT pid, max(edited_at) AS modified_at, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
            count(DISTINCT artist_uri) AS num_artists, count(DISTINCT album_uri) AS num_albums,
            count(DISTINCT order_id) AS num_edits,
            count(DISTINCT order_id) FILTER (WHERE is_final) AS num_followers
          FROM e_tracks GROUP BY pid)
        JOIN track_feats USING (pid)
        JOIN (SELECT * EXCLUDE (num_tracks) FROM artist_feats) USING (pid)
        LEFT JOIN names USING (pid)""",
    "q_edges": " UNION ALL ".join(_edges(c) for c in _STRATA),
    "strata": f"SELECT p.*, {', '.join(_class(c) for c in _STRATA)} FROM plist p",
    "first_split": f"""
        SELECT pid, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('{SPLIT_SEED}:' || pid), pid)
          <= floor(count(*) OVER (PARTITION BY stratum) * 0.1 + 0.5) THEN 'test' ELSE 'train' END AS part
        FROM (SELECT pid, CASE WHEN count(*) OVER (PARTITION BY {_CLASSES}) >= 5
          THEN concat_ws('-', {_CLASSES}) ELSE 'rest' END AS stratum FROM strata)""",
    "drawn": f"""
        SELECT pid, CASE WHEN row_number() OVER (ORDER BY md5('{EVAL_SEED}:' || pid), pid)
          <= floor(count(*) OVER () / 2) THEN 'dev' ELSE 'test' END AS part
        FROM first_split WHERE part = 'test' AND pid NOT IN (
          SELECT pid FROM e_tracks SEMI JOIN (SELECT pid FROM first_split WHERE part = 'test') USING (pid)
          WHERE track_uri NOT IN (SELECT track_uri FROM e_tracks
            SEMI JOIN (SELECT pid FROM first_split WHERE part = 'train') USING (pid)))""",
    "parts": """
        SELECT plist.pid, coalesce(drawn.part, 'train') AS part, name, num_tracks
        FROM plist LEFT JOIN drawn USING (pid)""",
    "lists": f"""
        SELECT pid, part, name, num_tracks, [{', '.join(map(str, KS))}][CAST(CASE WHEN size = 0 THEN {len(KS) - 1}
          ELSE least((rn - 1) // size, {len(KS) - 1}) END AS INTEGER) + 1] AS k FROM (
          SELECT *, row_number() OVER (PARTITION BY part ORDER BY num_tracks, md5('{BUCKET_SEED}:' || pid), pid) AS rn,
            count(*) OVER (PARTITION BY part) // {len(KS)} AS size FROM parts WHERE part <> 'train')""",
    "part_tracks": """
        SELECT e.pid, pos, track_uri, artist_uri, parts.part, k, pos < k AS is_seed
        FROM e_tracks e JOIN parts ON e.pid = parts.pid LEFT JOIN lists ON e.pid = lists.pid""",
    "train_tracks": "SELECT pid, pos, track_uri FROM part_tracks WHERE part = 'train'",
    "train_lists": "SELECT pid, name, num_tracks FROM parts WHERE part = 'train'",
    "test_lists": "SELECT * FROM lists WHERE part = 'test'",
    "seeds": "SELECT pid, pos, track_uri FROM part_tracks WHERE part = 'test' AND is_seed",
    "truth": "SELECT pid, pos - k AS pos, track_uri, k FROM part_tracks WHERE part = 'test' AND NOT is_seed",
    "inclusion": "SELECT DISTINCT track_uri FROM part_tracks WHERE part <> 'train'",
    "cover": """
        SELECT DISTINCT pid FROM (SELECT track_uri, min(pid) AS pid FROM train_tracks
          WHERE track_uri IN (SELECT track_uri FROM inclusion) GROUP BY track_uri)""",
    "train_pop": "SELECT track_uri, count(*) AS freq FROM train_tracks GROUP BY track_uri",
    "vocab_items": """
        SELECT track_uri, row_number() OVER (ORDER BY freq DESC, md5('vocab:' || track_uri), track_uri) + 1 AS item_id,
          freq FROM train_pop WHERE freq > 5 OR track_uri IN (SELECT track_uri FROM inclusion)""",
    "full_vocab": """
        SELECT track_uri, item_id, freq FROM vocab_items
        UNION ALL SELECT '<eos>', 0, (SELECT count(DISTINCT pid) FROM train_tracks)
        UNION ALL SELECT '<unk>', 1, 0""",
    "marked": """
        SELECT pid, pos, track_uri FROM train_tracks
        UNION ALL SELECT pid, max(pos) + 1, '<eos>' FROM train_tracks GROUP BY pid""",
    "encoded": "SELECT pid, pos, item_id FROM marked JOIN full_vocab USING (track_uri)",
    "dense": "SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY pos) - 1 AS pos, item_id FROM encoded",
    "corpus": "SELECT pid, pos, item_id, row_number() OVER (ORDER BY pid, pos) - 1 AS i FROM dense",
    "transitions": transitions_sql("train_tracks"),
    "best_next": """
        SELECT prev, next, p, total FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) AS r
        FROM transitions) WHERE r = 1""",
    "known_seeds": """
        SELECT pid, prev, m / sum(m) OVER (PARTITION BY pid) AS weight FROM (
          SELECT pid, track_uri AS prev, count(*) AS m FROM seeds GROUP BY ALL)
        WHERE prev IN (SELECT prev FROM transitions)""",
    "full_recs": """
        SELECT pid, rank, track_uri, CAST(score AS DOUBLE) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, track_uri) AS rank FROM (
            SELECT pid, next AS track_uri, sum(CAST(weight * p AS DECIMAL(26, 12))) AS score
            FROM known_seeds JOIN transitions USING (prev) GROUP BY ALL) c
          WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.pid = c.pid AND s.track_uri = c.track_uri))
        WHERE rank <= 500""",
    "second_hop": "SELECT pid, b.next AS prev, sum(weight) AS weight FROM known_seeds JOIN best_next b USING (prev) GROUP BY ALL",
    "third_hop": "SELECT pid, b.next AS prev, sum(weight) AS weight FROM second_hop JOIN best_next b USING (prev) GROUP BY ALL",
    "semi_recs": semi_sql(["known_seeds", "second_hop"]),
    "three_hop_recs": semi_sql(["known_seeds", "second_hop", "third_hop"]),
    "train_keys": """
        SELECT pid, key, md5('title:' || pid) AS tie FROM (SELECT pid, CASE WHEN
          len(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: x <> '')) > 0 THEN
          array_to_string(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: x <> ''), '_')
          ELSE name END AS key FROM train_lists) WHERE key IS NOT NULL""",
    "test_keys": """
        SELECT pid, k, CASE WHEN
          len(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: x <> '')) > 0 THEN
          array_to_string(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: x <> ''), '_')
          ELSE name END AS key FROM test_lists""",
    "all_titles": """
        SELECT q.pid, q.k, t.pid AS candidate, levenshtein(q.key, t.key) AS distance,
          row_number() OVER (PARTITION BY q.pid ORDER BY levenshtein(q.key, t.key), t.tie) AS rank
        FROM test_keys q, train_keys t""",
    "near_titles": f"SELECT pid, k, rank, candidate, distance FROM all_titles WHERE rank <= {TIES + 1}",
    "title_tokens": f"""
        SELECT name, unnest(list_concat(
          flatten(list_transform(toks, lambda t: CASE {' '.join(f"WHEN t = {quoted(k)} THEN {w!r}" for k, w in SLANG)} ELSE [] END)),
          list_filter(toks, lambda t: t NOT IN ('playlist', 'music')))) AS token
        FROM (SELECT name, list_transform(string_split(squeezed, ' '),
            lambda t: trim(translate(trim(t), {quoted('_' + PUNCTUATION)}, ' '))) AS toks
          FROM (SELECT name, CASE WHEN length(replace(t, ' ', '')) - 1 <= length(t) - length(replace(t, ' ', ''))
              THEN replace(t, ' ', '') ELSE t END AS squeezed
            FROM (SELECT DISTINCT name, {_replaced(_replaced('trim(lower(name))', SLANG), EMOJI_TERMS, ' ')} AS t FROM names)))""",
    "word_vectors": """
        SELECT token, CAST(embedding AS DOUBLE[]) AS vec FROM (
          SELECT DISTINCT unnest(string_split(name, ' ')) AS token FROM names) w
        JOIN embeddings ON vec_id = CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)
        WHERE token <> ''""",
    "title_vectors": """
        SELECT name, list(x ORDER BY d) AS vec FROM (
          SELECT name, d, avg(x) AS x FROM (
            SELECT name, unnest(vec) AS x, generate_subscripts(vec, 1) AS d
            FROM title_tokens JOIN word_vectors USING (token))
          GROUP BY name, d) GROUP BY name""",
    "similar_lists": """
        SELECT pid, k, rank, candidate, similarity FROM (
          SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(similarity, 12) DESC, candidate) AS rank FROM (
            SELECT q.pid, q.k, t.pid AS candidate, sim AS similarity
            FROM test_lists q JOIN (
              SELECT a.name AS qname, b.name AS tname, list_cosine_similarity(a.vec, b.vec) AS sim
              FROM title_vectors a, title_vectors b
              WHERE a.name IN (SELECT name FROM test_lists) AND b.name IN (SELECT name FROM train_lists)) s ON q.name = qname
            JOIN train_lists t ON t.name = tname))
        WHERE rank <= 500""",
    "item_vecs": """
        SELECT CAST(vec_id AS VARCHAR) AS item, CAST(embedding AS DOUBLE[]) AS vec,
          'a' || label AS artist FROM embeddings""",
    "item_seeds": """
        SELECT pid, pos, CAST(CAST(track_uri AS BIGINT) % (SELECT count(*) FROM embeddings) AS VARCHAR) AS track_uri
        FROM seeds""",
    "item_sims": """
        SELECT seed, rank, item, similarity FROM (
          SELECT a.item AS seed, b.item AS item, round(list_cosine_similarity(a.vec, b.vec), 12) AS similarity,
            row_number() OVER (PARTITION BY a.item
              ORDER BY round(list_cosine_similarity(a.vec, b.vec), 12) DESC, b.item) AS rank
          FROM item_vecs a JOIN item_vecs b ON a.item <> b.item
          WHERE a.item IN (SELECT track_uri FROM item_seeds))""",
    "item_lists": """
        SELECT seed, item, artist, similarity, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, item) AS rank FROM (
            SELECT s.seed, s.item, v.artist, s.similarity,
              row_number() OVER (PARTITION BY s.seed, v.artist ORDER BY s.similarity DESC, s.item) AS place
            FROM item_sims s JOIN item_vecs v USING (item) JOIN item_vecs o ON o.item = s.seed
            WHERE v.artist <> o.artist)
          WHERE place <= 3)
        WHERE rank <= 500""",
    "mine": "SELECT pid, track_uri AS seed, min(pos) AS list_no FROM item_seeds GROUP BY ALL",
    "doc_tokens": """
        SELECT doc_id, generate_subscripts(w, 1) - 1 AS "at", unnest(w) AS token FROM (
          SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'),
            lambda x: x NOT IN ('the', 'and', 'of', 'la', 'le', 'der', 'en')) AS w FROM documents)""",
}
