"""Quality rules, line first: each line is held against punctuation, navigation, noise and boilerplate rules, failing
lines go, and a document that loses too much of its text goes as a whole.

DataFrame functions only, and no shuffle: a document's repeated word windows are found by sorting one long a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WS, WS, flat_spaces, packed, unpacked

SYMBOLS = r"[#*$%&|<>]+"
#: A line whose text has none of these ends no sentence.
SENTENCE_MARK = r"[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}:;]"
# Phrases of page furniture.
BOILERPLATE = r"all rights reserved|cookie|privacy policy|terms of use|terms of service|javascript|lorem ipsum|subscribe|newsletter|click here|sign in|log in|read more"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_LOST_PERCENT = 30


def line_fails(line: Column) -> Column:
    """True for a line that is noise or page furniture. The line has at least one word."""
    size = F.length(line)
    pipes = size - F.length(F.replace(line, F.lit("|"), F.lit("")))
    bangs = size - F.length(F.replace(line, F.lit("!!"), F.lit("")))
    symbols = size - F.length(F.regexp_replace(line, SYMBOLS, ""))
    navigation = (pipes >= 2) & (pipes * 20 >= size)
    noise = (symbols * 12 >= size) | ((bangs >= 4) & (bangs * 10 >= size))
    shouting = (size >= 20) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    no_sentence = (size >= 40) & ~line.rlike(SENTENCE_MARK)
    furniture = (size < 200) & F.lower(line).rlike(BOILERPLATE)
    return navigation | noise | shouting | no_sentence | furniture


def _windows(bits: str = "_bits") -> Column:
    """For each 3-word window its 64-bit hash, shifted left to make room for the window's number."""
    word = lambda i: F.get(F.col("_words"), i)
    key = lambda i: F.call_function("shiftleft", F.xxhash64(word(i), word(i + 1), word(i + 2)), F.col(bits)).bitwiseOR(i.cast("long"))
    none = F.array().cast("array<bigint>")
    return F.when(F.col("n_words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), key))).otherwise(none)


def _high(x: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, F.col("_bits"))


def _covered(starts: Column) -> Column:
    """Words in the windows that start at these sorted numbers; the array is read twice for each of its elements."""
    fresh = F.transform(starts, lambda p, j: F.least(F.lit(3).cast("long"), F.get(starts, j + 1) - p))
    return F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x)


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _lines. A null text counts as empty."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_parts", F.split(flat_spaces(F.col("_text")), " "))
    rows = rows.withColumn("_words", F.array_remove("_parts", "")).withColumns({
        "n_words": F.size("_words"), "word_chars": (F.length("_text") - F.size("_parts") + 1).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long"),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(NON_WS)),
    }).drop("_parts")
    rows = rows.withColumns({"n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_bits": F.length(F.bin(F.col("n_words").cast("long")))})
    rows = rows.withColumn("_sorted", _windows())
    same = lambda a, b: _high(a) == _high(b)
    rows = rows.withColumn("_twice", F.filter("_sorted", lambda x, j: same(x, F.get("_sorted", j + 1)) | same(x, F.get("_sorted", j - 1))))
    number = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    word = lambda x, d: F.get("_words", number(x).cast("int") + d)
    differ = lambda a, b: (word(a, 0) != word(b, 0)) | (word(a, 1) != word(b, 1)) | (word(a, 2) != word(b, 2))
    # Different windows with one hash show up as neighbours in the sorted list; such a document is sorted by its words.
    rows = rows.withColumn("_clash", F.size(F.filter("_twice", lambda x, j: same(x, F.get("_twice", j + 1)) & differ(x, F.get("_twice", j + 1)))) > 0)
    spelt = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), lambda i: F.struct(F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("w"), i.cast("long").alias("i"))))
    rows = rows.withColumn("_spelt", F.when(F.col("_clash"), spelt))
    by_words = F.transform(F.filter("_spelt", lambda x, j: (x["w"] == F.get("_spelt", j + 1)["w"]) | (x["w"] == F.get("_spelt", j - 1)["w"])), lambda x: x["i"])
    rows = rows.withColumn("_starts", F.sort_array(F.when(F.col("_clash"), by_words).otherwise(F.transform("_twice", number))))
    return rows.withColumns({"n_repeat_words": _covered(F.col("_starts")), "n_words": F.col("n_words").cast("long")}).drop("_words", "_sorted", "_twice", "_clash", "_spelt", "_starts", "_bits", "_text")


RESULTS = ["clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_removed", "chars_removed", "base_failed", "kept"]


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs with clean_text (the lines that pass, joined by line feeds), the measures, lines_removed, chars_removed
    (code points in words), base_failed and kept.

    A null text counts as empty and is not kept. An empty table gives none. Columns of docs may have any names; those called
    as the results are replaced."""
    rows = measure(packed(docs, text=F.col("text"))).withColumn("_bad", F.filter("_lines", line_fails))
    chars = lambda a, x: a + F.length(F.regexp_replace(x, WS, ""))
    rows = rows.withColumns({
        "clean_text": F.array_join(F.filter("_lines", lambda x: ~line_fails(x)), "\n"), "lines_removed": F.size("_bad").cast("long"),
        "chars_removed": F.aggregate("_bad", F.lit(0), chars).cast("long"),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT),
    })
    kept = ~F.col("base_failed") & (F.col("chars_removed") * 100 <= F.col("word_chars") * MOST_LOST_PERCENT)
    return unpacked(rows.withColumn("kept", kept), docs.columns, **{c: F.col(c) for c in RESULTS})


def quality_rows(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, without the texts."""
    return clean_lines(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "chars_removed")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
m AS (SELECT doc_id, t, lines, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, l, length(l) AS s FROM (SELECT doc_id, unnest(lines) AS l FROM m)),
bad AS (SELECT doc_id, l FROM (SELECT *, s - length(replace(l, '|', '')) AS pipes, s - length(replace(l, '!!', '')) AS bangs,
               s - length(regexp_replace(l, '[#*$%&|<>]+', '', 'g')) AS symbols FROM line)
        WHERE (pipes >= 2 AND pipes * 20 >= s) OR symbols * 12 >= s OR (bangs >= 4 AND bangs * 10 >= s)
           OR (s >= 20 AND regexp_matches(l, '\p{Lu}') AND NOT regexp_matches(l, '\p{Ll}'))
           OR (s >= 40 AND NOT regexp_matches(l, '[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}:;]'))
           OR (s < 200 AND regexp_matches(lower(l), 'all rights reserved|cookie|privacy policy|terms of use|terms of service|javascript|lorem ipsum|subscribe|newsletter|click here|sign in|log in|read more'))),
lost AS (SELECT doc_id, count(*)::BIGINT AS lines_removed, sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS chars_removed FROM bad GROUP BY doc_id),
j AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(lines_removed, 0) AS lines_removed, coalesce(chars_removed, 0) AS chars_removed
      FROM m LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND chars_removed * 100 <= word_chars * 30 AS kept,
       lines_removed, chars_removed
FROM j
"""
