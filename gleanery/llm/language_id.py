"""Language identification of mixed text.

A word's script, by ranges of code points, narrows the languages that it may be in; character n-grams score it in each
of these; Viterbi with a penalty for each switch labels every word, and equal labels make spans. A document's language
is that of most of its letters.

The n-gram counts come from labelled documents (a sample of bounded size); the model is a table of fixed width for each
language. Words are scored once a worker and kept, in a table of bounded size.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, slices, small_batches, words

UND = "und"
#: Documents to learn from, about: all labelled ones if there are fewer, else a pseudorandom choice by doc_id in each language.
TRAIN_DOCUMENTS = 12_000
#: No language is left fewer than about these, or all it has, however many languages share the documents.
LEAST_OF_LANGUAGE = 32
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: The longest run of bytes that counts as evidence.
MOST_BYTES = 5
SMOOTHING = 0.1
SWITCH_PENALTY = 12.0
#: No word counts more than this against a language of its script.
MOST_AGAINST = 8.0
#: Share of a language's letters from which a script is one of its own.
LEAST_SCRIPT_SHARE = 0.02
REMEMBERED = 300_000

# The first code points of runs of one script, and that script's name; letters elsewhere are "other".
SCRIPT_RUNS = [
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [x[0] for x in SCRIPT_RUNS]


def script_of(letter: str) -> str:
    k = bisect_right(_STARTS, ord(letter)) - 1
    return SCRIPT_RUNS[k][1] if k >= 0 else "other"


def word_script(word: str) -> str | None:
    """The script of the first letter; None if the word has none."""
    return next((script_of(c) for c in word if c.isalpha()), None)


def letter_count(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def word_grams(some: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For n from 1 to MOST_BYTES, the bucket of the n bytes from each place of the words in lower case, their edges
    marked, and whether they lie within one word; and each word's first place. No word is cut."""
    parts = [f"\x02{w.lower()}\x03".encode("utf-8", "replace") for w in some]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join([*parts, bytes(MOST_BYTES)]), np.uint8).astype(np.uint64)
    n = data.size - MOST_BYTES
    left = np.repeat(starts + sizes, sizes) - np.arange(n)
    code, out = np.zeros(n, np.uint64), []
    for k in range(MOST_BYTES):
        code = code * np.uint64(257) + data[k : n + k] + np.uint64(1)
        out.append((((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), left > k))
    return out, starts


class Model:
    """Languages in code-point order, their log probabilities by bucket, and their scripts."""

    def __init__(self, counts: dict[str, np.ndarray], letters: dict[str, dict[str, int]]) -> None:
        self.langs = sorted(counts)
        self.table = np.zeros((BUCKETS, len(self.langs)), np.float32)
        for k, lang in enumerate(self.langs):
            smooth = counts[lang].astype(np.float64) + SMOOTHING
            self.table[:, k] = np.log(smooth / smooth.sum())
        self.scripts = {}
        for k, lang in enumerate(self.langs):
            total = sum(letters[lang].values())
            for script, n in letters[lang].items():
                if n >= LEAST_SCRIPT_SHARE * total:
                    self.scripts.setdefault(script, []).append(k)
        self.digest = hashlib.sha256(self.table.tobytes() + repr((self.langs, sorted(self.scripts.items()))).encode()).hexdigest()


def training_sample(labelled: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """About train_documents rows of labelled: as many of each language, but all of a language that has fewer."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if sum(sizes.values()) <= train_documents:
        return labelled
    left, quota = train_documents, 0.0
    for nth, n in enumerate(sorted(sizes.values())):
        quota = left / (len(sizes) - nth)
        if n > quota:
            break
        left -= n
    quota = max(quota, LEAST_OF_LANGUAGE)
    shares = [(lang, int((1 << 30) * min(1.0, quota / n))) for lang, n in sizes.items()]
    small = F.broadcast(labelled.sparkSession.createDataFrame(shares, "lang string, _below long"))
    return labelled.join(small, "lang").where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < F.col("_below")).drop("_below")


def fit(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> Model:
    """A model of the labelled rows of docs: doc_id, text, lang. Rows with a null in any of these are left out."""
    labelled = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    chosen = training_sample(labelled, train_documents)
    counted = chosen.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").count()

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        letters: dict[str, dict[str, int]] = {}
        for batch in batches:
            found: dict[str, tuple[list[str], list[int]]] = {}
            for lang, word, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (script := word_script(word)) is None:
                    continue
                own = letters.setdefault(lang, {})
                own[script] = own.get(script, 0) + times * letter_count(word)
                some, weights = found.setdefault(lang, ([], []))
                some.append(word)
                weights.append(times)
            for lang, (some, weights) in found.items():
                levels, starts = word_grams(some)
                each = np.repeat(weights, np.diff(np.append(starts, levels[0][0].size)))
                sums[lang] = sums.get(lang, 0) + sum(np.bincount(at[inside], each[inside], BUCKETS) for at, inside in levels).astype(np.int64)
        langs = list(sums)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "counts": pa.array([sums[x].tobytes() for x in langs], pa.binary()), "letters": pa.array([list(letters[x].items()) for x in langs], pa.map_(pa.string(), pa.int64()))})

    counts: dict[str, np.ndarray] = {}
    letters: dict[str, dict[str, int]] = {}
    # One table of fixed width for each language and task; as many tasks as the sample, of bounded size, needs.
    for row in counted.coalesce(8).mapInArrow(count, "lang string, counts binary, letters map<string,long>").toLocalIterator():
        counts[row.lang] = counts.get(row.lang, 0) + np.frombuffer(row.counts, np.int64)
        own = letters.setdefault(row.lang, {})
        for script, k in row.letters.items():
            own[script] = own.get(script, 0) + k
    return Model(counts, letters)


def best_labels(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each row that maximises the sum of scores less `penalty` for each change of label.

    One label throughout is best unless leaving it pays: a run of other labels costs one penalty at an edge, two inside,
    and gains at most the sum of what the best other label is ahead by, row by row. Only where some run gains more is
    the Viterbi loop needed. Of equal paths that with lower label numbers wins, from the end."""
    n, k = scores.shape
    top = int(scores.sum(0).argmax())
    if k == 1:
        return np.zeros(n, np.int32)
    ahead = np.concatenate([[0.0], np.cumsum(np.delete(scores, top, axis=1).max(axis=1) - scores[:, top], dtype=np.float64)])
    inside = (ahead - np.minimum.accumulate(ahead)).max()
    if inside <= 2 * penalty and ahead.max() <= penalty and ahead[-1] - ahead.min() <= penalty:
        return np.full(n, top, np.int32)
    path, came = [0.0] * k, np.empty((n, k), np.int32)
    labels = range(k)
    for t, row in enumerate(scores.tolist()):
        high = max(path)
        from_high, least = path.index(high), high - penalty
        back = came[t]
        for j in labels:
            if path[j] >= least:
                back[j] = j
                path[j] += row[j]
            else:
                back[j] = from_high
                path[j] = least + row[j]
    out = np.empty(n, np.int32)
    at = path.index(max(path))
    for t in range(n - 1, -1, -1):
        out[t] = at
        at = came[t, at]
    return out


class Labeller:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(self.model.langs)), np.float32)
        self.letters, self.foreign = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def learn(self, fresh: list[str]) -> None:
        model, first = self.model, len(self.known)
        while first + len(fresh) > len(self.rows):
            self.rows, self.letters, self.foreign = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.letters, self.foreign))
        for lo in range(0, len(fresh), 4096):
            part = fresh[lo : lo + 4096]
            levels, starts = word_grams(part)
            gains = np.zeros((levels[0][0].size, len(model.langs)), np.float32)
            for at, inside in levels:
                gains[inside] += model.table[at[inside]]
            sums = np.add.reduceat(gains, starts, axis=0)
            of_script: dict[str | None, list[int]] = {}
            for k, word in enumerate(part):
                script = word_script(word)
                of_script.setdefault(script, []).append(k)
                if script is not None:
                    (self.letters if script in model.scripts else self.foreign)[first + lo + k] = letter_count(word)
                self.known[word] = first + lo + k
            for script, some in of_script.items():
                at, allowed = np.array(some), model.scripts.get(script)
                if allowed:
                    own = sums[np.ix_(at, allowed)]
                    rows = np.full((at.size, len(model.langs)), -2 * MOST_AGAINST, np.float32)
                    rows[:, allowed] = np.maximum(own - own.max(axis=1, keepdims=True), -MOST_AGAINST)
                    self.rows[first + lo + at] = rows

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each text its words' labels (-1: in no language's script, or without letters), their letters in such
        scripts, and the letters of the other words."""
        split = [[w.decode("utf-8", "replace") for w in t.encode("utf-8", "replace").split()] if not t.isascii() else t.translate(_ONLY_ASCII).split() for t in texts]
        every = dict.fromkeys(w for found in split for w in found)
        fresh = [w for w in every if w not in self.known]
        if fresh and self.known and len(self.known) + len(fresh) > REMEMBERED:
            self.forget()
            fresh = list(every)
        self.learn(fresh)
        out = []
        for found in split:
            at = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
            letters = self.letters[at]
            labels = np.full(len(found), -1, np.int32)
            if (some := np.flatnonzero(letters)).size:
                labels[some] = best_labels(self.rows[at[some]], SWITCH_PENALTY)
            out.append((labels, letters, int(self.foreign[at].sum())))
        return out


#: str.split() also splits at these ASCII control characters, which are parts of words here.
_ONLY_ASCII = {c: "\x01" for c in range(0x1C, 0x20)}


def identify(docs: DataFrame, model: Model, *, spans: bool = True) -> DataFrame:
    """docs with lang_pred, score and (spans) lang_spans: array of first word, number of words and language.

    lang_pred is the label of most letters, of equal ones the first language; `und` if the text is null or has no letter,
    or nothing was learnt. score is its share of all letters, 0 for `und`; words in no language's script have no label,
    so a text of such words alone gets the first language with score 0. Only the text is read. Columns of docs with the
    names of results are replaced."""
    shipped, key, langs = docs.sparkSession.sparkContext.broadcast(model), f"labels {model.digest}", model.langs
    added = [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double")]
    if spans:
        added.append(("lang_spans", pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])), "array<struct<first_word:int,n_words:int,lang:string>>"))
    rest = [f for f in docs.schema.fields if f.name not in {x[0] for x in added}]
    text_at = [f.name for f in rest].index("text")

    def run(batches):
        labeller = once(key, lambda: Labeller(shipped.value))
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in slices(whole.column(text_at), 1 << 20)):
            out: list[list] = [[] for _ in added]
            for labels, letters, foreign in labeller.label([x if x and langs else "" for x in batch.column(text_at).to_pylist()]):
                share = np.bincount(labels[labels >= 0], weights=letters[labels >= 0], minlength=1)
                top, total = int(share.argmax()), float(share.sum()) + foreign
                row = [langs[top], float(share[top]) / total] if total else [UND, 0.0]
                if spans:
                    edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)] if len(labels) else [0]
                    row.append([{"first_word": a, "n_words": b - a, "lang": langs[labels[a]] if labels[a] >= 0 else UND} for a, b in zip(edges, edges[1:], strict=False)])
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, (_, t, _) in zip(out, added, strict=True))], names=[*(f.name for f in rest), *(x[0] for x in added)])

    return small_batches(docs.select(*(f.name for f in rest))).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{n} {t}" for n, _, t in added)]))


def held_out() -> Column:
    """True for a fifth of all documents, by the CRC of doc_id; for a null doc_id as well."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0, F.lit(True))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the documents that are not held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, spans=False).drop("text")
