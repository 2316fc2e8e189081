"""Citation markers in answers: [1], [1, 3], and full-width ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of a marker, and of one after a full stop.
MARKER = r"\[(\d+(?:\s*,\s*\d+)*)\]"
WIDE_MARKER = r"【\s*(\d+(?:\s*[,，]\s*\d+)*)\s*】"
AFTER_STOP = r"([.!?])((?:[ \t]*\[\d+(?:\s*,\s*\d+)*\])+)"


def normalise_markers(text: Column) -> Column:
    """Full-width markers as plain ones, their full-width commas too; what stands outside them stays as it is."""
    open_, close = "\ue000", "\ue001"  # private characters, that no text has
    inside = F.regexp_replace(F.regexp_replace(text, WIDE_MARKER, f"{open_}$1{close}"), f"，(?=[^{open_}{close}]*{close})", ",")
    return F.translate(inside, open_ + close, "[]")


def marker_numbers(text: Column) -> Column:
    """The numbers cited, in sequence, with repeats."""
    groups = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.cast("int"))


def bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, MARKER, ""))


def is_claim(sentence: Column) -> Column:
    """A digit, or four words, beside the markers."""
    left = bare(sentence)
    return left.rlike(r"\d") | (F.size(F.filter(F.split(left, r"\s+"), lambda w: w != "")) >= 4)


def sentences(text: Column) -> Column:
    """Sentences with their markers: markers after a full stop go before it, and a fragment of markers alone joins the
    sentence before."""
    moved = F.regexp_replace(text, AFTER_STOP, "$2$1")
    parts = F.filter(F.transform(F.split(moved, r"(?<=[.!?])\s+|\n+"), lambda p: F.trim(p)), lambda s: s != "")
    only_markers = lambda s: F.regexp_replace(F.regexp_replace(s, MARKER, ""), r"^[ .,;:]+|[ .,;:]+$", "") == ""
    empty = F.array().cast("array<string>")
    join = lambda acc, s: F.when((F.size(acc) > 0) & only_markers(s), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, F.size(acc)), s)))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(parts, empty, join)


def uncited_claims(text: Column) -> Column:
    return F.filter(sentences(text), lambda s: is_claim(s) & ~s.rlike(MARKER))


def first_uses(numbers: Column, valid: Column) -> tuple[Column, Column]:
    """The distinct numbers that name a source, in order of first use, and those that name none."""
    return F.array_distinct(F.filter(numbers, lambda n: F.array_contains(valid, n))), F.array_distinct(F.filter(numbers, lambda n: ~F.array_contains(valid, n)))


def strip_invalid(text: Column, valid: Column) -> Column:
    """The text with only those numbers left in its markers that name a source; empty markers go."""
    pieces = F.split(text, rf"(?={MARKER})|(?<=\])")
    numbers = lambda p: F.filter(F.split(F.regexp_extract(p, MARKER, 1), r"\s*,\s*"), lambda x: F.array_contains(valid, x.cast("int")))
    fix = lambda p: F.when(p.rlike(f"^{MARKER}$"), F.when(F.size(numbers(p)) > 0, F.concat(F.lit("["), F.array_join(numbers(p), ", "), F.lit("]"))).otherwise("")).otherwise(p)
    return F.array_join(F.transform(pieces, fix), "")


def page_label(page: Column, page_end: Column) -> Column:
    return F.when(page == page_end, F.concat(F.lit("p. "), page)).otherwise(F.concat(F.lit("pp. "), page, F.lit("–"), page_end))
