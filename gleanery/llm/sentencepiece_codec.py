"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text is escaped (a blank becomes U+2581, one more goes in front if the model says so) and cut before each run of
U+2581; as no piece has that mark after another character, the best split of the text is that of its cuts, one by one.
Each worker keeps the splits of cuts that it has met, in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import once, slices, small_batches
from .vocabulary import DEFAULT_MODEL, NORMAL, SPACE, USER_DEFINED, Vocabulary, build_trie, read_model

UNKNOWN_PENALTY = 10.0
#: Cuts remembered by a worker, and the longest that is, in characters.
REMEMBERED, LONGEST = 400_000, 64


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        usable = {p.encode(): k for k, p in enumerate(vocabulary.pieces) if vocabulary.kinds[k] in (NORMAL, USER_DEFINED) and p}
        inner = [p for p in vocabulary.pieces if SPACE in p.lstrip(SPACE)]
        breaks = [] if any("\n" in p for p in vocabulary.pieces) else ["\n"]
        self.cutter = None if inner else re.compile("".join([*breaks, "|"] if breaks else []) + f"{SPACE}*[^{SPACE}{''.join(breaks)}]+|{SPACE}+")
        self.trie = build_trie(usable)
        self.scores = vocabulary.scores
        size = len(self.trie.check)
        base = np.array(self.trie.base, np.int64)
        self.tables = (np.where(base < 0, size, base), np.concatenate([np.array(self.trie.check, np.int64), np.full(512, -1)]), np.array(self.trie.value, np.int64), np.array(vocabulary.scores, np.float64))
        self.unknown_score = min(vocabulary.scores[k] for k in usable.values()) - UNKNOWN_PENALTY
        self.byte_ids = vocabulary.byte_ids
        self.packed = [int(k).to_bytes(4, "little") for k in range(len(vocabulary.pieces))]
        self.known: dict[str, bytes] = {}
        of_byte = {k: b for b, k in enumerate(self.byte_ids)}
        self.spelt = [bytes([of_byte[k]]) if k in of_byte else b"" if kind not in (NORMAL, USER_DEFINED) else p.replace(SPACE, " ").encode() for k, (p, kind) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True))]
        self.spelt[vocabulary.unknown_id] = " ⁇ ".encode()

    def best_split(self, cut: str) -> list[int]:
        """Ids of the split with the highest sum of scores; of equal ones that whose last piece starts first.

        A character that no piece stands for alone may be left unknown, below every piece's score; its bytes' pieces,
        or the unknown piece, take its place."""
        data = cut.encode("utf-8", "surrogatepass")
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best, came, by = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, alone = best[at], 0, False
            for end in range(at, n):
                child = base[node] + data[end]
                if child < 0 or check[child] != node:
                    break
                node = child
                k = value[node]
                if k >= 0:
                    score = here + scores[k]
                    if score > best[end + 1]:
                        best[end + 1], came[end + 1], by[end + 1] = score, at, k
                    alone |= end + 1 == at + width
            if not alone and here + self.unknown_score > best[at + width]:
                best[at + width], came[at + width], by[at + width] = here + self.unknown_score, at, -1
            at += width
        out: list[int] = []
        end = n
        while end:
            start = came[end]
            if by[end] >= 0:
                out.append(by[end])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(data[start:end]))
            else:
                out.append(self.vocabulary.unknown_id)
            end = start
        return out[::-1]

    def split_many(self, cuts: list[str]) -> list[bytes]:
        """best_split of each, packed: the same steps, taken for all cuts of about one length at once."""
        data = [c.encode("utf-8", "surrogatepass") for c in cuts]
        out: list[bytes] = [b""] * len(cuts)
        order = sorted(range(len(cuts)), key=lambda k: len(data[k]))
        for lo in range(0, len(order), 8192):
            own = order[lo : lo + 8192]
            own_data = [data[k] for k in own]
            longest = len(own_data[-1])
            if longest > 4 * LONGEST:
                for k in own:
                    out[k] = self._packed(self.best_split(cuts[k]))
                continue
            for k, x in zip(own, self._split_block(own_data, longest), strict=True):
                out[k] = x if x is not None else self._packed(self.best_split(cuts[k]))
        return out

    def _split_block(self, data: list[bytes], longest: int) -> list[bytes | None]:
        """None for a cut whose best split leaves a character unknown."""
        base, check, value, scores = self.tables
        n = len(data)
        sizes = np.fromiter(map(len, data), np.int64, n)
        text = np.frombuffer(b"".join(x.ljust(longest + 1, b"\0") for x in data), np.uint8).reshape(n, longest + 1).astype(np.int64)
        widths = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best, came, by = np.full((n, longest + 4), -np.inf), np.zeros((n, longest + 4), np.int32), np.full((n, longest + 4), -1, np.int32)
        best[:, 0] = 0.0
        for at in range(longest):
            rows = np.flatnonzero((sizes > at) & (best[:, at] > -np.inf))
            if not rows.size:
                continue
            here, node, alone, width = best[rows, at], np.zeros(rows.size, np.int64), np.zeros(rows.size, bool), widths[rows, at]
            going, end = np.arange(rows.size), at
            while going.size and end < longest:
                child = base[node[going]] + text[rows[going], end]
                ok = (check[child] == node[going]) & (end < sizes[rows[going]])
                going, child = going[ok], child[ok]
                node[going] = child
                end += 1
                piece = value[child]
                hit = piece >= 0
                if hit.any():
                    some, piece = going[hit], piece[hit]
                    score = here[some] + scores[piece]
                    better = score > best[rows[some], end]
                    into = rows[some[better]]
                    best[into, end], came[into, end], by[into, end] = score[better], at, piece[better]
                    alone[some] |= end - at == width[some]
            lost = np.flatnonzero(~alone)
            score, end_of = here[lost] + self.unknown_score, at + width[lost]
            better = score > best[rows[lost], end_of]
            into, end_of = rows[lost[better]], end_of[better]
            best[into, end_of], came[into, end_of], by[into, end_of] = score[better], at, -1
        ends, steps, known = sizes.copy(), [], np.ones(n, bool)
        every = np.arange(n)
        while (ends > 0).any():
            on = ends > 0
            piece = np.where(on, by[every, ends], -2)
            known &= piece != -1
            steps.append(piece)
            ends = np.where(on, came[every, ends], 0)
        pieces = np.array(steps[::-1], "<i4").T if steps else np.empty((n, 0), "<i4")
        counts = (pieces != -2).sum(axis=1)
        width, packed = pieces.shape[1], np.ascontiguousarray(pieces).tobytes()
        return [packed[4 * ((k + 1) * width - c) : 4 * (k + 1) * width] if good else None for k, (c, good) in enumerate(zip(counts.tolist(), known.tolist(), strict=True))]

    def _packed(self, ids: list[int]) -> bytes:
        return b"".join(map(self.packed.__getitem__, ids))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers, in sequence."""
        prefix = SPACE if self.vocabulary.add_dummy_prefix else ""
        escaped = [prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        split = [self.cutter.findall(x) if self.cutter else [x] * bool(x) for x in escaped]
        every = dict.fromkeys(c for own in split for c in own)
        fresh = [c for c in every if c not in self.known]
        if self.known and len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(every)
        found = dict(zip(fresh, self.split_many(fresh), strict=True))
        long = {c: found.pop(c) for c in fresh if len(c) > LONGEST}
        self.known.update(found)
        if long:
            return [b"".join([long[c] if c in long else self.known[c] for c in own]) for own in split]
        return [b"".join(map(self.known.__getitem__, own)) for own in split]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: marks become blanks, byte pieces the characters that they spell (U+FFFD where they spell
        none), and the blank that encoding put in front goes."""
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.add_dummy_prefix and text[:1] == " " else text


def encode_documents(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", *, digests: bool = False) -> DataFrame:
    """docs with piece_ids array<int>, n_pieces, n_byte_pieces, and round_trip (decoding gives the text again).

    A null text has a null piece_ids, no pieces, and round_trip null; an empty one has an empty array. A literal U+2581
    decodes as a blank, so its round_trip is false. digests: ids_sha256 (of the ids as little-endian 32-bit integers) in
    place of piece_ids and the text. Columns of docs with the names of results are replaced. The model file is read on
    the driver, and sent: a vocabulary, of a size that doesn't depend on the input."""
    spark = docs.sparkSession
    vocabulary = read_model(model)
    shipped, key = spark.sparkContext.broadcast(vocabulary), f"codec {vocabulary.digest}"
    added = [("ids_sha256", pa.string(), "string")] if digests else [("piece_ids", pa.list_(pa.int32()), "array<int>")]
    added += [("n_pieces", pa.int64(), "long"), ("n_byte_pieces", pa.int64(), "long"), ("round_trip", pa.bool_(), "boolean")]
    gone = {x[0] for x in added} | ({text} if digests else set())
    rest = [f for f in docs.schema.fields if f.name not in gone]
    columns = list(dict.fromkeys([*(f.name for f in rest), text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{n} {t}" for n, _, t in added)])

    def encode(batches):
        codec = once(key, lambda: Codec(shipped.value))
        marks = np.isin(np.arange(len(codec.packed)), codec.byte_ids)
        for batch in batches:
            for lo, hi in slices(batch.column(columns.index(text)), 1 << 20):
                part = batch.slice(lo, hi - lo)
                out: list[list] = [[] for _ in added]
                texts = part.column(columns.index(text)).to_pylist()
                for x, packed in zip(texts, codec.encode_many([x or "" for x in texts]), strict=True):
                    if x is None:
                        row = [None, 0, 0, None]
                    else:
                        ids = np.frombuffer(packed, "<i4")
                        row = [hashlib.sha256(packed).hexdigest() if digests else ids, len(ids), int(marks[ids].sum()), codec.decode(ids.tolist()) == x]
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                kept = [part.column(columns.index(f.name)) for f in rest]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, (_, t, _) in zip(out, added, strict=True))], names=[*(f.name for f in rest), *(n for n, _, _ in added)])

    return small_batches(docs.select(*columns)).mapInArrow(encode, schema)


def decode_documents(rows: DataFrame, model: str = DEFAULT_MODEL, ids: str = "piece_ids", into: str = "text") -> DataFrame:
    """rows with the text of their piece ids; null ids give a null text. An id outside of the vocabulary is an error."""
    vocabulary = read_model(model)
    shipped, key = rows.sparkSession.sparkContext.broadcast(vocabulary), f"codec {vocabulary.digest}"
    rest = [f for f in rows.schema.fields if f.name != into]
    names = [f.name for f in rest]

    def decode(batches):
        codec = once(key, lambda: Codec(shipped.value))
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, into])

    return small_batches(rows.select(*names)).mapInArrow(decode, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{into}` string"]))
