"""Feature, interaction and word-vector tables and replacement dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

INTERACTION = "user int, item int, rating float"
# Dictionary entries that may be turned into one expression.
MAX_TERMS = 10_000


def write_features(features: DataFrame, path: str) -> None:
    """Feature table as CSV with a header."""
    features.write.mode("overwrite").csv(path, header=True)


def read_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Feature table with its types; missing texts stay null."""
    return spark.read.schema(schema).csv(path, header=True)


def write_interactions(rows: DataFrame, path: str) -> None:
    """(user, item, rating) as TSV without header."""
    rows.select("user", "item", "rating").write.mode("overwrite").csv(path, sep="\t")


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERACTION).csv(path, sep="\t")


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """Text lines ``token x1 x2 ...``."""
    numbers = F.array_join(F.col("vec").cast("array<string>"), " ")
    vectors.select(F.concat_ws(" ", "token", numbers)).write.mode("overwrite").text(path)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, vec) from text lines; a leading ``count size`` line is skipped."""
    cells = F.split("value", " ")
    rows = spark.read.text(path).select(cells.alias("c")).where(F.size("c") > 2)
    return rows.select(
        F.col("c")[0].alias("token"), F.slice("c", 2, F.size("c")).cast("array<double>").alias("vec")
    )


def read_replacement_dict(spark: SparkSession, path: str, limit: int = MAX_TERMS) -> list[tuple[str, list[str]]]:
    """(key, words) pairs of a JSON-lines dictionary, in key order.

    The pairs become part of an expression, so their number is checked.
    """
    rows = spark.read.schema("key string, tokens array<string>").json(path).orderBy("key").limit(limit + 1)
    found = [(r["key"], list(r["tokens"])) for r in rows.collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} terms")
    return found
