"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations


def load():
    """All queries and their SQL."""
    from checks import evaluation, features, recommend, registry, sources, splits, text, titles  # noqa: F401

    return registry.QUERIES, registry.SQL
