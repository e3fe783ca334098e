"""Title clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ASCII punctuation without the underscore, and title stop words.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
TITLE_STOP_WORDS = ["playlist", "music"]

Terms = list[tuple[str, list[str]]]


def title_key(name: Column) -> Column:
    """Lower-case words joined by ``_``; a title without words stays as it is."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(words, "_")).otherwise(name)


def replace_terms(title: Column, terms: Terms, lead: str = "") -> Column:
    """Replace each term that occurs in the title by its words, in list order."""
    if not terms:
        return title
    pairs = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(lead + " ".join(v)).alias("text")) for k, v in terms]
    )
    return F.aggregate(pairs, title, lambda t, p: F.replace(t, p["key"], p["text"]))


def squeeze_spaced(title: Column) -> Column:
    """``p l a y`` becomes ``play``: spaces go when they are as many as the gaps."""
    letters = F.replace(title, F.lit(" "), F.lit(""))
    spaces = F.length(title) - F.length(letters)
    return F.when(F.length(letters) - 1 <= spaces, letters).otherwise(title)


def strip_punct(token: Column) -> Column:
    """Drop punctuation, turn ``_`` into a space, trim."""
    return F.trim(F.translate(token, "_" + PUNCTUATION, " "))


def title_tokens(name: Column, slang: Terms, emoji: Terms) -> Column:
    """Tokens of a title: terms replaced, spaced words joined, punctuation dropped.

    Known slang tokens bring their words along; title stop words are left out.
    """
    text = replace_terms(F.trim(F.lower(name)), slang)
    text = squeeze_spaced(replace_terms(text, emoji, " "))
    tokens = F.transform(F.split(text, " ", -1), lambda t: strip_punct(F.trim(t)))
    kept = F.filter(tokens, lambda t: ~t.isin(TITLE_STOP_WORDS))
    if not slang:
        return kept
    words = F.create_map(*[x for k, v in slang for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    extra = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(words, t), none)))
    return F.concat(extra, kept)


def hours_label(milliseconds: Column) -> Column:
    """``3h 07m`` style label without padding: ``3h 7m``."""
    minutes = F.floor(milliseconds / 60000)
    return F.format_string("%dh %dm", F.floor(minutes / 60), minutes % 60)


def epoch_day(seconds: Column) -> Column:
    """Calendar day (UTC) of epoch seconds, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
