"""Text expressions: lexemes and positions, query splitting, normalising, occurrences."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Lexemes of the plain analyser: letters and digits of any script.
LEXEME = r"[\p{L}\p{N}]+"
#: A figure with thousands separators counts as a phrase in a question.
GROUPED_NUMBER = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b"
QUOTED = r'"([^"]*)"'

# English words that carry no meaning for search.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does "
    "doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its "
    "itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so "
    "some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with you your yours yourself yourselves"
).split()


def lexemes(text: Column) -> Column:
    """Lexemes in sequence, repeats kept; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LEXEME), F.lit(0))


def without_stop_words(words: Column, stop: list[str] | tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else F.array_distinct(words)


def positions(words: Column) -> Column:
    """Map of each lexeme to its 1-based positions; stop words keep their place in the count."""
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i + 1)), lambda p: p.isNotNull()))))


def split_query(question: Column) -> tuple[Column, Column]:
    """Phrases of a question (quoted text first, then figures with separators in what is left; blank ones dropped), and
    the rest with each phrase replaced by a blank."""
    quoted = F.regexp_extract_all(question, F.lit(QUOTED), F.lit(1))
    left = F.regexp_replace(question, QUOTED, " ")
    figures = F.regexp_extract_all(left, F.lit(GROUPED_NUMBER), F.lit(0))
    phrases = F.filter(F.transform(F.concat(quoted, figures), lambda p: F.trim(p)), lambda p: p != "")
    return phrases, F.regexp_replace(left, GROUPED_NUMBER, " ")


def has_phrase(words: Column, phrase: Column) -> Column:
    """The phrase's words stand side by side somewhere in words."""
    n = F.size(phrase)
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return (n > 0) & F.exists(starts, lambda i: F.slice(words, i, n) == phrase)


def places(text: str, quote: str) -> Iterator[int]:
    """All offsets of quote in text, overlapping ones too: the search goes on from each, so the text is read once."""
    at = text.find(quote) if quote else -1
    while at >= 0:
        yield at
        at = text.find(quote, at + 1)


@F.pandas_udf(ArrayType(IntegerType()))
def _places(text: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None or q is None else list(places(t, q)) for t, q in zip(text, quote, strict=True)])


def occurrences(text: Column, quote: Column) -> Column:
    """All 0-based offsets of quote in text, overlapping ones too."""
    return _places(text, quote)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition (ligatures, full-width forms, no-break spaces); there is no built-in for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def collapse(text: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    return collapse(nfkc(text))


def edge_key(text: Column) -> Column:
    """Key under which running headers of different pages are equal: digits as #, none at the ends. text is normalised."""
    return F.regexp_replace(F.regexp_replace(text, r"\d+", "#"), r"^#\s+|\s+#$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
