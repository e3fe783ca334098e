"""Text mining over documents, titles and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from encore.functions.text import clean_html
from encore.operators import ranking, textmining
from encore.sources.workspace import spread

STOP = ["the", "and", "of", "la", "le", "der", "en"]
MARKS = "[%*#&$]"


def toks(s):
    return s.stored("doc_tokens", lambda: textmining.tokens(s.docs, STOP))


def scores(s):
    return s.stored("tf_idf", lambda: textmining.tf_idf(s.docs, toks(s)))


@query("m1_tokens", 'SELECT doc_id, "at", token FROM doc_tokens')
def _(s):
    return textmining.tokens(s.docs, STOP)


_LEMMAS = "SELECT DISTINCT token, substr(token, 1, length(token) - 2) AS lemma FROM doc_tokens WHERE token LIKE '%ing'"


def lemmas(s):
    words = toks(s).where("token like '%ing'").select("token").distinct()
    return words.withColumn("lemma", F.expr("substr(token, 1, length(token) - 2)"))


_LEMMATISED = f'SELECT doc_id, "at", token, coalesce(lemma, token) AS lemma FROM doc_tokens LEFT JOIN ({_LEMMAS}) USING (token)'


@query("m2_lemmatise", f"SELECT lemma, count(*) AS n FROM ({_LEMMATISED}) GROUP BY lemma")
def _(s):
    return textmining.token_counts(textmining.lemmatise(toks(s), lemmas(s)), "lemma")


@query("m3_lemma_to_word", f'SELECT lemma, arg_max(token, doc_id * 1000000 + "at") AS token FROM ({_LEMMATISED}) GROUP BY lemma')
def _(s):
    return textmining.lemma_to_word(textmining.lemmatise(toks(s), lemmas(s)))


@query("m4_token_counts", "SELECT token, count(*) AS n FROM doc_tokens GROUP BY token ORDER BY n DESC, token LIMIT 25")
def _(s):
    return ranking.top_k(textmining.token_counts(toks(s)), [F.desc("n"), "token"], 25)


_TF_IDF = """(SELECT doc_id, token, n / sum(n) OVER (PARTITION BY doc_id) AS tf,
      log10((SELECT count(*) FROM documents) / count(*) OVER (PARTITION BY token)) AS idf
    FROM (SELECT doc_id, token, count(*) AS n FROM doc_tokens GROUP BY ALL))"""


@query("m5_tf_idf", f"SELECT doc_id, token, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tf_idf FROM {_TF_IDF}")
def _(s):
    return rounded(textmining.tf_idf(s.docs, toks(s)), "tf", "idf", "tf_idf")


@query(
    "m6_inverted_index",
    """SELECT token, doc_id // 4096 AS block, string_agg(doc_id, ' ' ORDER BY doc_id) AS ids
       FROM (SELECT DISTINCT token, doc_id FROM doc_tokens) GROUP BY ALL""",
)
def _(s):
    return textmining.inverted_index(toks(s)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))


@query("m6_lookup", "SELECT DISTINCT doc_id FROM doc_tokens WHERE token = 'on'")
def _(s):
    return textmining.lookup(textmining.inverted_index(toks(s)), "on")


@query("m7_defining_terms", f"SELECT token, round(sum(tf * idf), 4) AS score FROM {_TF_IDF} GROUP BY token ORDER BY score DESC, token LIMIT 20")
def _(s):
    rows = rounded(textmining.defining_terms(scores(s)), "score", digits=4)
    return ranking.top_k(rows, [F.desc("score"), "token"], 20)


@query(
    "m8_bigrams",
    """SELECT token, count(*) AS n FROM (SELECT token || '_' || lead(token) OVER (PARTITION BY doc_id ORDER BY "at") AS token
       FROM doc_tokens) WHERE token IS NOT NULL GROUP BY token ORDER BY n DESC, token LIMIT 20""",
)
def _(s):
    counts = textmining.token_counts(textmining.bigrams(s.docs, STOP))
    return ranking.top_k(counts, [F.desc("n"), "token"], 20)


_SYMBOLS = f"(SELECT page_id, unnest(regexp_extract_all(html, '{MARKS}')) AS token FROM pages)"


def pages(s):
    return spread(s.table("pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


@query("m9_symbol_profile", f"SELECT token, count(*) AS n, count(DISTINCT page_id) AS docs FROM {_SYMBOLS} GROUP BY token")
def _(s):
    return textmining.symbol_profile(pages(s), MARKS)


@query("m10_rows_with_symbol", f"SELECT page_id AS doc_id FROM pages WHERE page_id IN (SELECT page_id FROM {_SYMBOLS} WHERE token = '%')")
def _(s):
    index = textmining.inverted_index(textmining.symbols(pages(s), MARKS))
    return textmining.rows_with_symbol(pages(s), index, "%").select("doc_id")


@query(
    "m11_clean_html",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(replace(lower(html), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
       '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')) AS text FROM pages""",
)
def _(s):
    return pages(s).select(F.col("doc_id").alias("page_id"), F.md5(clean_html(F.col("text"))).alias("text"))
