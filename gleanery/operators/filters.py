"""Filters, validation of requests, known-value checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guard import bad_controls


def membership(**allowed: list | None) -> Column:
    """AND of column IN values; a column without values is unrestricted."""
    out = F.lit(True)
    for name, values in allowed.items():
        if values:
            out = out & F.col(name).isin(list(values))
    return out


def in_partition(**values) -> Column:
    out = F.lit(True)
    for name, value in values.items():
        out = out & (F.col(name) == F.lit(value))
    return out


def any_lexeme(lexemes: Column, words: Column) -> Column:
    return F.arrays_overlap(lexemes, words)


def trailing_window(ts: str, as_of, hours: float) -> Column:
    """Rows less than `hours` before as_of, a timestamp given by the caller."""
    if not 0 < hours <= 2160:
        raise ValueError("hours is above 0 and 2160 at most")
    return F.col(ts) > F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(hours * 3600.0).cast("decimal(18,6)"))


def has_key(column: Column, key: str) -> Column:
    """The JSON map has that key, dots and all."""
    return F.map_contains_key(F.from_json(column, "map<string,double>"), key)


def exists_in(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(other, on, "left_semi")


def unknown_values(requested: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct requested values that the known rows don't have."""
    return requested.select(column).distinct().join(known.select(column).distinct(), column, "left_anti")


def request_problem(question: Column, k: Column, companies: Column, years: Column) -> Column:
    """Why a request is invalid, the first reason that holds; null if it is not."""
    return F.coalesce(
        F.when(question.isNull() | (F.length(question) < 1) | (F.length(question) > 2000), F.lit("question_length")),
        F.when(F.trim(question) == "", F.lit("question_blank")),
        F.when((k < 1) | (k > 20), F.lit("k_range")),
        F.when((F.size(companies) > 10) | (F.size(years) > 10), F.lit("too_many_values")),
        F.when(F.exists(years, lambda y: (y < 1990) | (y > 2100)), F.lit("year_range")),
        F.when(bad_controls(question), F.lit("control_characters")),
    )


def lookup(rows: DataFrame, **key) -> DataFrame:
    """The rows with these values: by an id, one or none."""
    return rows.where(in_partition(**key))


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def wanted_ids(rows: DataFrame, ids: list, column: str = "id") -> DataFrame:
    """The rows with these ids; an error for ids that aren't there."""
    found = rows.where(F.col(column).isin(list(ids)))
    have = {r[0] for r in found.select(column).distinct().collect()}
    if missing := [x for x in ids if x not in have]:
        raise ValueError(f"unknown ids: {missing}")
    return found


def near_empty(text: Column, image_share: Column | None = None, least_chars: int = 200, scanned_share: float = 0.5) -> tuple[Column, Column]:
    """Pages with hardly any text, and those of them that images cover."""
    empty = F.length(F.trim(text)) < least_chars
    return empty, empty & ((image_share >= scanned_share) if image_share is not None else F.lit(False))
