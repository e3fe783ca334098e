"""Queries over the test tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.tables import TABLES
from encore.sources.star import Star, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_tables(final: str) -> str:
    """Put the shared table expressions that a statement uses in front of it."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, body in TABLES.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                need(body)
                if name not in used:
                    used.append(name)

    need(final)
    if not used:
        return final
    head = ", ".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in used)
    return f"WITH {head} {final}"


def query(name: str, sql: str | None = None):
    """Register a function of the playlist tables under a name."""

    def keep(build: Callable[[Star], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(star(spark, folder))
        if sql is not None:
            SQL[name] = with_tables(sql)
        return build

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round float columns, as sums differ in their last bits with the order of addition."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})
