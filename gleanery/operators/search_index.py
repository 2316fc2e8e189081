"""The stored keyword index: a row for each document, with its postings, and the statistics of lexemes and of the whole set.

A row is made where the document is, and nothing is shuffled: a search scans the columns that its rank function needs, scores
each row where it lies and keeps k for each question and task. So neither the build nor a search sends postings over the
network. The statistics are computed when the index is refreshed, which happens only if the rows have changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemmer import stem, stem_column
from ..functions.text import LEXEME, STOP_WORDS, lexemes
from ..settings import one_of

#: Documents whose postings a task makes at once, and bytes of their texts.
SLICE, SLICE_BYTES = 1024, 1 << 23
#: Code points whose class is asked for in one row.
PLANE = 1 << 16
ANALYSERS = ("plain", "english")
#: Stems that a worker remembers at a time.
REMEMBERED = 200_000


def analysed(text: Column, analyser: str) -> Column:
    """The text's lexemes in sequence. english: stemmed, and null where a stop word stands."""
    words = lexemes(text)
    return words if one_of("analyser", analyser, ANALYSERS) == "plain" else F.transform(words, lambda w: F.when(~w.isin(STOP_WORDS), w))


def question_lexemes(questions: DataFrame, text: Column, analyser: str, *columns: str) -> DataFrame:
    """columns, at (0-based), lexeme: a row for each lexeme of a question, stemmed if the analyser stems."""
    rows = questions.select(*columns, F.posexplode(analysed(text, analyser)).alias("at", "lexeme")).where("lexeme IS NOT NULL")
    return rows.withColumn("lexeme", stem_column("lexeme")) if analyser == "english" else rows


_LETTERS: dict[str, np.ndarray] = {}


def letters_of(spark: SparkSession) -> np.ndarray:
    """Of each code point whether it belongs to lexemes, as Spark's expression LEXEME says."""
    own = spark.sparkContext.applicationId
    if own not in _LETTERS:
        every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        planes = [(n, "".join(map(chr, every[lo : lo + PLANE]))) for n, lo in enumerate(range(0, len(every), PLANE))]
        found = spark.createDataFrame(planes, "n int, s string").select("n", F.regexp_replace("s", LEXEME.removesuffix("+"), "").alias("rest")).collect()
        letters = np.zeros(0x110000, bool)
        letters[every] = True
        for r in found:
            letters[[ord(c) for c in r.rest]] = False
        _LETTERS[own] = letters
    return _LETTERS[own]


def words_of(texts: pa.StringArray, letters: np.ndarray) -> pa.ListArray:
    """The runs of letters of each text. Texts are looked at as bytes, all at once; none is null."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if data.size and data.max() < 0x80:
        inside = letters[data]
    else:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        inside = np.repeat(letters[points], 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
    begun = inside.copy()
    begun[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < data.size]
    begun[first] = inside[first]
    starts = np.flatnonzero(begun)
    kept = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(kept[starts] - 1, kept[-1:] if kept.size else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(starts.size, pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends), pa.int32()), words)


def _slices(batch: pa.RecordBatch):
    """Parts of a batch of at most SLICE rows and SLICE_BYTES of text, or one row."""
    ends = np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: batch.num_rows + 1]
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + SLICE, batch.num_rows, max(lo + 1, int(np.searchsorted(ends, int(ends[lo]) + SLICE_BYTES, side="right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _coded(words: pa.Array, stems) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the number of each word among them, and which count; stems turns an array of words into one of
    stems, and then stop words don't count."""
    coded = words.dictionary_encode()
    names, codes = coded.dictionary, np.asarray(coded.indices, np.int64)
    valid = np.ones(codes.size, bool)
    if stems is not None and len(names):
        valid = np.asarray(pc.index_in(names, value_set=pa.array(STOP_WORDS)).is_null())[codes]
    if stems is not None and len(names):
        joined = stems(names).dictionary_encode()
        names, codes = joined.dictionary, np.asarray(joined.indices, np.int64)[codes]
    return names, codes, valid


def _counts_of(words: pa.ListArray, stems, only: pa.Array | None) -> list[pa.Array]:
    """length, total, lexemes and tfs of each text's words. only: lexemes that lists are confined to; lengths count all."""
    names, codes, valid = _coded(words.flatten(), stems)
    sizes, n = np.asarray(words.value_lengths(), np.int64), max(1, len(names))
    doc = np.repeat(np.arange(sizes.size), sizes)[valid]
    key = np.sort(doc * n + codes[valid])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.empty(0, np.int64)
    tfs, key = np.diff(np.append(first, key.size)), key[first]
    row, code = key // n, key % n
    lengths = np.bincount(row, minlength=sizes.size)
    if only is not None:
        kept = np.asarray(pc.index_in(names, value_set=only).is_valid())[code] if len(names) else np.empty(0, bool)
        row, code, tfs = row[kept], code[kept], tfs[kept]
    outer = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=sizes.size))]), pa.int32())
    lists = [names.take(pa.array(code)), pa.array(tfs, pa.int32())]
    return [pa.array(lengths, pa.int32()), pa.array(np.bincount(doc, minlength=sizes.size), pa.int32()), *[pa.ListArray.from_arrays(outer, x) for x in lists]]


def _rows_of(words: pa.ListArray, stems) -> list[pa.Array]:
    """length, total, lexemes, tfs and positions of each text's words."""
    names, codes, valid = _coded(words.flatten(), stems)
    sizes = np.asarray(words.value_lengths(), np.int64)
    doc = np.repeat(np.arange(sizes.size), sizes)
    at = np.arange(doc.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    doc, at, key = doc[valid], at[valid], doc[valid] * max(1, len(names)) + codes[valid]
    width = int(at.max(initial=0)) + 1
    if sizes.size * max(1, len(names)) * width < 1 << 62:
        key, at = np.divmod(np.sort(key * width + at), width)
    else:
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.empty(0, np.int64)
    lengths = np.bincount(key[first] // max(1, len(names)), minlength=sizes.size)
    outer = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    inner = np.append(first, key.size)
    lists = [names.take(pa.array(key[first] % max(1, len(names)))), pa.array(np.diff(inner), pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(at, pa.int32()))]
    return [pa.array(lengths, pa.int32()), pa.array(np.bincount(doc, minlength=sizes.size), pa.int32()), *[pa.ListArray.from_arrays(outer, x) for x in lists]]


def document_rows(docs: DataFrame, *, id: str = "doc_id", text: str = "text", analyser: str = "plain", positions: bool = True, only: list[str] | None = None) -> DataFrame:
    """id, length (distinct lexemes), total (all lexemes), and side by side lexemes, tfs and positions (1-based; stop words
    count): a row for each document, made where it is. Without positions, lists can be confined to some lexemes."""
    if only is not None and positions:
        raise ValueError("only is for rows without positions")
    own = None if only is None else pa.array(only, pa.string())
    names = ["id", "length", "total", "lexemes", "tfs", *(["positions"] if positions else [])]
    kind = docs.schema[id].dataType.simpleString()
    known: dict[str, str] = {}

    def stems(words: pa.Array) -> pa.Array:
        if len(known) >= REMEMBERED:
            known.clear()
        for word in words.to_pylist():
            if word not in known:
                known[word] = stem(word)
        return pa.array([known[word] for word in words.to_pylist()], pa.string())

    stemmer = stems if one_of("analyser", analyser, ANALYSERS) == "english" else None
    letters = docs.sparkSession.sparkContext.broadcast(letters_of(docs.sparkSession))

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                words = words_of(part.column(1), letters.value)
                lists = _rows_of(words, stemmer) if positions else _counts_of(words, stemmer, own)
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=names)

    return docs.select(F.col(id).alias("id"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")).mapInArrow(run, f"id {kind}, length int, total int, lexemes array<string>, tfs array<int>{', positions array<array<int>>' if positions else ''}")


@dataclass(frozen=True)
class Index:
    """rows: as document_rows() gives them. lexemes: lexeme, df. n: rows. mean: their average length."""

    rows: DataFrame
    lexemes: DataFrame
    n: int
    mean: float
    analyser: str

    @property
    def postings(self) -> DataFrame:
        """lexeme, id, tf, length, total, positions: a row for each lexeme of each document."""
        each = self.rows.select("id", "length", "total", F.explode(F.arrays_zip("lexemes", "tfs", "positions")).alias("_p"))
        return each.select(F.col("_p.lexemes").alias("lexeme"), "id", F.col("_p.tfs").cast("long").alias("tf"), "length", "total", F.col("_p.positions").alias("positions"))


def _lexemes_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("lexemes").alias("lexeme")).groupBy("lexeme").agg(F.count("*").alias("df"))


def _set_of(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.sum("length").cast("double"), F.count("*")), F.lit(0.0)).alias("mean"))


def fingerprint(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row that changes with the rows' number, ids or texts."""
    return docs.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(id, text)).alias("hashes"), F.sum(F.pmod(F.xxhash64(text, id), F.lit(1 << 30))).alias("sums"))


def refresh(docs: DataFrame, folder: str, *, id: str = "doc_id", text: str = "text", analyser: str = "plain") -> bool:
    """Writes the index of docs to the folder, if what lies there isn't that of the same rows. True if it was written.

    The fingerprint is written last, so an index that was left half-way counts as missing."""
    spark = docs.sparkSession
    now = fingerprint(docs, id, text)
    if any(tuple(r) == tuple(now.first()) for r in _if_there(spark, f"{folder}/fingerprint")):
        return False
    document_rows(docs, id=id, text=text, analyser=analyser).write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    _lexemes_of(rows).write.mode("overwrite").parquet(f"{folder}/lexemes")
    _set_of(rows).write.mode("overwrite").parquet(f"{folder}/set")
    now.write.mode("overwrite").parquet(f"{folder}/fingerprint")
    return True


def _if_there(spark: SparkSession, path: str) -> list:
    """Rows of a small table, none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    return spark.read.parquet(path).collect() if there else []


def stored(spark: SparkSession, folder: str, analyser: str = "plain") -> Index:
    n, mean = spark.read.parquet(f"{folder}/set").select("n", "mean").first()
    return Index(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/lexemes"), n, mean, analyser)


def write_for(docs: DataFrame, folder: str, lexemes: list[str], *, id: str = "doc_id", text: str = "text", analyser: str = "plain") -> None:
    """Writes what a batch of questions with these lexemes needs of the index of docs: lists of these lexemes alone, without
    positions. Lengths, the number of rows and their average are those of the whole texts, so scores are the same."""
    document_rows(docs, id=id, text=text, analyser=analyser, positions=False, only=lexemes).write.mode("overwrite").parquet(f"{folder}/rows")
    rows = docs.sparkSession.read.parquet(f"{folder}/rows")
    _lexemes_of(rows).write.mode("overwrite").parquet(f"{folder}/lexemes")
    _set_of(rows).write.mode("overwrite").parquet(f"{folder}/set")


def unstored(docs: DataFrame, *, id: str = "doc_id", text: str = "text", analyser: str = "plain") -> Index:
    """The same for one search, made from the rows themselves each time that they are read."""
    rows = document_rows(docs, id=id, text=text, analyser=analyser)
    n, mean = _set_of(rows).first()
    return Index(rows, _lexemes_of(rows), n, mean, analyser)


def as_index(source: Index | DataFrame, id: str, text: str, analyser: str) -> Index:
    return source if isinstance(source, Index) else unstored(source, id=id, text=text, analyser=analyser)
