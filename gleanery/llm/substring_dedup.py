"""Substring dedup by fixed-block anchors.

Reference blocks of BLOCK words at every BLOCK-th word of a document are indexed; every rolling window of BLOCK words
probes the index. As any WINDOW >= 2 * BLOCK words hold a whole block of their own document, a repeat of that length is
hit in both documents. Hits are extended: windows of WINDOW words about them are compared among all documents, by 128-bit
cryptographic digests of their words under a key drawn for the run, and overlapping ones found in an earlier document make
up the maximal repeats, which go. Rolling hashes only choose the windows: a clash costs a comparison and removes nothing.

Documents are dealt into groups of bounded size by a hash. A group sends its distinct hashes, sorted and packed, to
their buckets; a bucket answers with one bit for each hash in its place in the sorted list, so neither documents nor
positions travel. What is hot is combined within its group first: one hash goes to a bucket at most once from a group.
The text is shuffled once; its exchange serves all three passes.
"""

from __future__ import annotations

import os
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, small_batches, whole_ids
from .hashing import WindowHash, joined_words, word_edges

WINDOW, BLOCK = 50, 25
#: Text of a group and words of a bucket: the least and the most. Between them both grow with the root of the input.
GROUP_BYTES, BUCKET_WORDS = (4 << 20, 64 << 20), (1 << 20, 64 << 20)
#: Hashes that a group sends to a bucket at least, on average, as long as the most are not reached.
PARCEL_HASHES = 1000
LAST = np.iinfo(np.int64).max
PARCEL = "bucket int, part int, kind int, body binary, extra binary"
NAMES = ["bucket", "part", "kind", "body", "extra"]
TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
HASHES, ANCHORS = 0, 1


def planes(x: np.ndarray) -> bytes:
    """The array's bytes, all lowest ones first: planes of equal bytes compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(x.size, x.itemsize).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def parcels(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)] if rows else [pa.array([], t) for t in TYPES], names=NAMES)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    if not columns[0].size:
        return np.empty(0, np.int64)
    new = np.zeros(columns[0].size, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Texts:
    """A group's documents, in an order that depends on nothing but their contents."""

    def __init__(self, table: pa.Table, key: bytes) -> None:
        rows = [(LAST if i is None else i, joined_words((t or "").encode("utf-8", "surrogatepass")), i) for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)]
        rows.sort(key=lambda r: r[:2])
        self.order, self.joined, self.ids = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        self.key, self.hasher = key, once(f"substring hash {key.hex()}", lambda: WindowHash(key))

    def rolling(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Keys of all rolling blocks (the hash's `bits` highest bits), which are aligned, their documents, and the
        number of blocks of each document."""
        keys = [self.hasher.windows(joined.split(), BLOCK) >> np.uint64(64 - bits) for joined in self.joined]
        counts = [k.size for k in keys]
        if not sum(counts):
            return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.int32), counts
        return np.concatenate(keys), np.concatenate([np.arange(n) % BLOCK == 0 for n in counts]), np.repeat(np.arange(len(counts), dtype=np.int32), counts), counts

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the chosen of all windows: both halves of the digest of its words, document and first word."""
        digests, docs, firsts = [], [], []
        at = 0
        for k, joined in enumerate(self.joined):
            n = max(0, joined.count(b" ") + 2 - WINDOW) if joined else 0
            own = np.flatnonzero(chosen[at : at + n])
            at += n
            if own.size:
                starts, ends = word_edges(np.frombuffer(joined, np.uint8))
                view = memoryview(joined)
                digests += [blake2b(view[a:z], digest_size=16, salt=self.key).digest() for a, z in zip(starts[own].tolist(), ends[own + WINDOW - 1].tolist(), strict=True)]
                docs.append(np.full(own.size, k, np.int32))
                firsts.append(own)
        if not digests:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64)
        halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        return halves[:, 0].copy(), halves[:, 1].copy(), np.concatenate(docs), np.concatenate(firsts)


def sorted_blocks(texts: Texts, bits: int):
    keys, aligned, docs, counts = texts.rolling(bits)
    order = np.argsort(keys, kind="stable")
    starts = run_starts(keys[order])
    return keys[order], order, starts, aligned, docs, counts


def probe(part: int, texts: Texts, bucket_bits: int) -> pa.Table:
    """The group's distinct block keys for each bucket, with two bits each: in more documents than one, and indexed."""
    keys, order, starts, aligned, docs, _ = sorted_blocks(texts, bucket_bits + 32)
    if not keys.size:
        return parcels([])
    docs = docs[order]
    ends = np.append(starts[1:], keys.size) - 1
    many, indexed, keys = docs[starts] != docs[ends], np.logical_or.reduceat(aligned[order], starts), keys[starts]
    buckets = (keys >> np.uint64(32)).astype(np.int64)
    rest = keys.astype(np.uint32)
    cuts = run_starts(buckets)
    rows = []
    for lo, hi in zip(cuts, np.append(cuts[1:], buckets.size), strict=True):
        steps = np.diff(rest[lo:hi], prepend=np.uint32(0))
        rows.append((int(buckets[lo]), part, HASHES, planes(steps), np.packbits(many[lo:hi]).tobytes() + np.packbits(indexed[lo:hi]).tobytes()))
    return parcels(rows)


def answer_blocks(table: pa.Table) -> pa.Table:
    """For each parcel a bit for each key: indexed by some document, and in more documents than one."""
    sent = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "part", "body", "extra")), strict=True))
    keys, many, indexed, sizes = [], [], [], []
    for _, _, body, extra in sent:
        own = np.cumsum(unplanes(body, np.uint32), dtype=np.uint32)
        half = len(extra) // 2
        keys.append(own)
        many.append(np.unpackbits(np.frombuffer(extra[:half], np.uint8), count=own.size).astype(bool))
        indexed.append(np.unpackbits(np.frombuffer(extra[half:], np.uint8), count=own.size).astype(bool))
        sizes.append(own.size)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    starts = run_starts(key[order])
    lengths = np.diff(np.append(starts, key.size))
    live = np.logical_or.reduceat(np.concatenate(indexed)[order], starts) & ((lengths > 1) | np.logical_or.reduceat(np.concatenate(many)[order], starts))
    bits = np.empty(key.size, bool)
    bits[order] = np.repeat(live, lengths)
    return parcels([(b, p, ANCHORS, np.packbits(x).tobytes(), None) for (b, p, _, _), x in zip(sent, np.split(bits, np.cumsum(sizes)[:-1]), strict=True) if x.any()])


def extend(part: int, texts: Texts, answers: dict[int, bytes], bucket_bits: int) -> pa.Table:
    """The windows about the group's hits: distinct digests for each bucket, each with the first document that has it. To
    this group itself: which windows those are, which of them an earlier document of the group has, each one's number among
    the distinct digests, and where the buckets' digests begin."""
    keys, order, starts, _, _, counts = sorted_blocks(texts, bucket_bits + 32)
    if not keys.size or not answers:
        return parcels([])
    lengths = np.diff(np.append(starts, keys.size))
    distinct = (keys[starts] >> np.uint64(32)).astype(np.int64)
    cuts = run_starts(distinct)
    live = np.zeros(starts.size, bool)
    for lo, hi in zip(cuts, np.append(cuts[1:], distinct.size), strict=True):
        if (bits := answers.get(int(distinct[lo]))) is not None:
            live[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    hits = np.empty(keys.size, bool)
    hits[order] = np.repeat(live, lengths)
    chosen, at = [], 0
    for n in counts:
        if n > WINDOW - BLOCK:
            sums = np.concatenate([[0], np.cumsum(hits[at : at + n])])
            chosen.append(sums[WINDOW - BLOCK + 1 :] > sums[: -(WINDOW - BLOCK + 1)])
        at += n
    chosen = np.concatenate(chosen) if chosen else np.empty(0, bool)
    if not chosen.any():
        return parcels([])
    high, low, docs, _ = texts.windows(chosen)
    order = np.lexsort((docs, low, high))
    high, low, docs = high[order], low[order], docs[order]
    starts = run_starts(high, low)
    lengths = np.diff(np.append(starts, high.size))
    ids = np.array(texts.order, np.int64)[docs]
    number, later = np.empty(order.size, np.uint32), np.empty(order.size, bool)
    number[order] = np.repeat(np.arange(starts.size, dtype=np.uint32), lengths)
    later[order] = ids > np.repeat(ids[starts], lengths)
    high, low, first = high[starts], low[starts], ids[starts]
    buckets = (high >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(high.size, np.int64)
    cuts = run_starts(buckets)
    rows = [(int(buckets[lo]), part, HASHES, planes(high[lo:hi]) + planes(low[lo:hi]), planes(first[lo:hi])) for lo, hi in zip(cuts, np.append(cuts[1:], buckets.size), strict=True)]
    own = np.packbits(chosen).tobytes(), np.packbits(later).tobytes(), planes(number), planes(np.append(cuts, buckets.size).astype(np.int64))
    return parcels([*rows, (part % (1 << bucket_bits), part, ANCHORS, b"".join(own), planes(np.array([len(x) for x in own], np.int64)))])


def answer_windows(table: pa.Table) -> pa.Table:
    """For each parcel a bit for each window: in a document before the group's first one. Others are passed on."""
    rows = list(zip(*(table.column(c).to_pylist() for c in NAMES), strict=True))
    sent, out = [r for r in rows if r[2] == HASHES], [r for r in rows if r[2] == ANCHORS]
    if sent:
        sizes = [len(r[4]) // 8 for r in sent]
        high = np.concatenate([unplanes(r[3][: 8 * n], np.uint64) for r, n in zip(sent, sizes, strict=True)])
        low = np.concatenate([unplanes(r[3][8 * n :], np.uint64) for r, n in zip(sent, sizes, strict=True)])
        first = np.concatenate([unplanes(r[4], np.int64) for r in sent])
        order = np.lexsort((low, high))
        starts = run_starts(high[order], low[order])
        least = np.minimum.reduceat(first[order], starts)
        earlier = np.empty(first.size, bool)
        earlier[order] = np.repeat(least, np.diff(np.append(starts, first.size))) < first[order]
        out += [(r[0], r[1], HASHES, np.packbits(x).tobytes(), None) for r, x in zip(sent, np.split(earlier, np.cumsum(sizes)[:-1]), strict=True)]
    return parcels(out)


def repeats(texts: Texts, own: tuple[bytes, bytes] | None, answers: dict[int, bytes], buckets: list[int]) -> list[list[tuple[int, int]]]:
    """For each document its maximal repeats: (first word, number of words). own: what extend sent to this group; answers:
    the buckets' bits; buckets: those with an answer, in order."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts.joined]
    if own is None:
        return out
    body, sizes = own
    ends = np.cumsum(unplanes(sizes, np.int64)).tolist()
    later_at, number_at, cuts_at, _ = ends
    number, cuts = unplanes(body[number_at:cuts_at], np.uint32), unplanes(body[cuts_at:], np.int64)
    later = np.unpackbits(np.frombuffer(body[later_at:number_at], np.uint8), count=number.size).astype(bool)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(body[:later_at], np.uint8)))
    earlier = np.concatenate([np.unpackbits(np.frombuffer(answers[b], np.uint8), count=hi - lo) for b, lo, hi in zip(buckets, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]).astype(bool)
    windows = [max(0, joined.count(b" ") + 2 - WINDOW) if joined else 0 for joined in texts.joined]
    begins = np.concatenate([[0], np.cumsum(windows)])
    at = at[earlier[number] | later]
    docs = np.searchsorted(begins, at, side="right") - 1
    firsts = at - begins[docs]
    if docs.size:
        new = np.ones(docs.size, bool)
        new[1:] = (docs[1:] != docs[:-1]) | (firsts[1:] > firsts[:-1] + WINDOW)
        begin = np.flatnonzero(new)
        for a, z in zip(begin, np.append(begin[1:], docs.size) - 1, strict=True):
            out[docs[a]].append((int(firsts[a]), int(firsts[z] - firsts[a]) + WINDOW))
    return out


def exchange_sizes(total: int) -> tuple[int, int]:
    """Bytes of a group and words of a bucket for so many bytes of text: a parcel, what a group sends to a bucket, holds
    group * bucket / total hashes, so both grow alike until it has PARCEL_HASHES, or both are as large as a task can hold."""
    factor = max(1.0, (PARCEL_HASHES * total / (GROUP_BYTES[0] * BUCKET_WORDS[0])) ** 0.5)
    return min(GROUP_BYTES[1], int(GROUP_BYTES[0] * factor)), min(BUCKET_WORDS[1], int(BUCKET_WORDS[0] * factor))


def remove_repeats(docs: DataFrame, group_bytes: int | None = None, bucket_words: int | None = None) -> DataFrame:
    """doc_id, n_words, repeats (array of first_word, n_words) and kept_text: one row for each of docs.

    A word goes if a window of WINDOW words that covers it also starts in a document with a smaller doc_id; kept_text is
    the other words joined by blanks. Windows are judged on the input. Null texts have no words. Rows with a null doc_id
    come after all others, and rows of one doc_id are no reference for each other. doc_id is a whole number (else TypeError).
    An empty table gives none. Other columns of docs are not read. A document is held whole by the task of its group."""
    whole_ids(docs, "doc_id")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    own_sizes = exchange_sizes(total)
    group_bytes, bucket_words = group_bytes or own_sizes[0], bucket_words or own_sizes[1]
    salt = os.urandom(16)  # in the closures: a task that is run again uses the same
    n_groups = max(1, -(-total // group_bytes))
    bits = max(0, (max(1, total // 6 // bucket_words) - 1).bit_length())
    texts = small_batches(docs).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def first(key, table):
        return probe(key[0].as_py(), Texts(table, salt), bits)

    def second(key, table, answers):
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True))
        return extend(key[0].as_py(), Texts(table, salt), got, bits) if table.num_rows else parcels([])

    def third(key, table, answers):
        texts_ = Texts(table, salt) if table.num_rows else None
        kinds, buckets, bodies, extras = (answers.column(c).to_pylist() for c in ("kind", "bucket", "body", "extra"))
        got = {b: x for k, b, x in zip(kinds, buckets, bodies, strict=True) if k == HASHES}
        sent = next(((x, y) for k, x, y in zip(kinds, bodies, extras, strict=True) if k == ANCHORS), None)
        rows: list[tuple] = []
        if texts_ is not None:
            for doc_id, joined, spans in zip(texts_.ids, texts_.joined, repeats(texts_, sent, got, sorted(got)), strict=True):
                n, kept = joined.count(b" ") + 1 if joined else 0, joined
                if spans:
                    edge = word_edges(np.frombuffer(joined, np.uint8))[0]
                    parts, at = [], 0
                    for word, count in [*spans, (n, 0)]:
                        if word > at:
                            parts.append(joined[edge[at] : edge[word] - 1 if word < n else None])
                        at = word + count
                    kept = b" ".join(parts)
                rows.append((doc_id, n, [{"first_word": a, "n_words": c} for a, c in spans], kept.decode("utf-8", "surrogatepass")))
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())])), pa.string()]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "n_words", "repeats", "kept_text"])

    by_part = texts.groupBy("part")
    hits = by_part.applyInArrow(first, PARCEL).groupBy("bucket").applyInArrow(answer_blocks, PARCEL)
    found = by_part.cogroup(hits.groupBy("part")).applyInArrow(second, PARCEL).groupBy("bucket").applyInArrow(answer_windows, PARCEL)
    return by_part.cogroup(found.groupBy("part")).applyInArrow(third, "doc_id long, n_words long, repeats array<struct<first_word:long,n_words:long>>, kept_text string")


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    rows = remove_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, x: a + x["n_words"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM x JOIN f USING (h) WHERE first < doc_id),
word AS (SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
