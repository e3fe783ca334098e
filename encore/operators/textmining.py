"""Terms, scores and indexes of titles and descriptions.

Texts come as (doc_id, text); tokens as (doc_id, at, token).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from encore.functions.text import EMOJI, words
from encore.operators.skew import salted_join
from encore.sources.workspace import cut

# Ids per posting block, so that no posting list is one unbounded array.
POSTINGS = 4096


def tokens(docs: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """(doc_id, at, token) without stop words, numbered after their removal."""
    return docs.select("doc_id", F.posexplode(words(F.col("text"), stop_words)).alias("at", "token"))


def lemmatise(rows: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Add ``lemma`` from a (token, lemma) table; unknown tokens stand for themselves."""
    named = salted_join(rows, lemmas, "token", how="left")
    return named.withColumn("lemma", F.coalesce("lemma", "token"))


def lemma_to_word(rows: DataFrame) -> DataFrame:
    """(lemma, token): the last token seen for each lemma."""
    return rows.groupBy("lemma").agg(F.max_by("token", F.struct("doc_id", "at")).alias("token"))


def token_counts(rows: DataFrame, column: str = "token") -> DataFrame:
    """(token, n)."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def tf_idf(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, token, tf, idf, tf_idf): tf = n / tokens of the doc, idf = log10(N / df).

    N counts all documents, empty ones too.
    """
    counts = cut(rows.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")))
    lengths = counts.groupBy("doc_id").agg(F.sum("n").alias("length"), F.count(F.lit(1)).alias("_terms"))
    seen = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1))).scalar()
    with_length = salted_join(counts, lengths, "doc_id", "_terms").drop("_terms")
    scored = salted_join(with_length, seen, "token", "df")
    tf, idf = F.col("n") / F.col("length"), F.log10(total / F.col("df"))
    return scored.select("doc_id", "token", tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("tf_idf"))


def inverted_index(rows: DataFrame, column: str = "token") -> DataFrame:
    """(token, block, ids): sorted document ids per term, in blocks of an id range."""
    pairs = rows.select(column, "doc_id").distinct()
    return pairs.groupBy(column, F.floor(F.col("doc_id") / POSTINGS).alias("block")).agg(
        F.sort_array(F.collect_list("doc_id")).alias("ids")
    )


def lookup(index: DataFrame, term: str, column: str = "token") -> DataFrame:
    """Document ids of one term."""
    return index.where(F.col(column) == term).select(F.explode("ids").alias("doc_id"))


def defining_terms(scores: DataFrame) -> DataFrame:
    """(token, score): summed tf-idf of each term."""
    return scores.groupBy("token").agg(F.sum("tf_idf").alias("score"))


def bigrams(docs: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """(doc_id, at, token): neighbouring words joined by ``_``."""
    w = words(F.col("text"), stop_words)
    rows = docs.select("doc_id", w.alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.concat_ws("_", a, b))
    return rows.select("doc_id", F.posexplode(pairs).alias("at", "token"))


def symbols(docs: DataFrame, pattern: str = EMOJI) -> DataFrame:
    """(doc_id, at, token): every match of a symbol pattern."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return docs.select("doc_id", F.posexplode(found).alias("at", "token"))


def symbol_profile(docs: DataFrame, pattern: str = EMOJI) -> DataFrame:
    """(token, n, docs): mentions and documents per symbol."""
    per_doc = symbols(docs, pattern).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def rows_with_symbol(docs: DataFrame, index: DataFrame, symbol: str) -> DataFrame:
    """Documents that hold a symbol."""
    return docs.join(lookup(index, symbol), "doc_id", "left_semi")
