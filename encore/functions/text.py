"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

# Unicode word pattern and the emoji block of the symbol profile.
WORD = r"(?U)\w+"
EMOJI = r"[\x{1F600}-\x{1F650}]"


def words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of a text without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    if stop_words:
        return F.filter(found, lambda w: ~w.isin(stop_words))
    return found


def clean_html(text: Column) -> Column:
    """Lower-case text with all HTML entities resolved, in Arrow batches."""

    @F.pandas_udf("string")
    def unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import html

        for batch in batches:
            yield batch.map(html.unescape, na_action="ignore")

    return unescape(F.lower(text))
