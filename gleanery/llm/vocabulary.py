"""SentencePiece model files, and a double-array trie over their pieces."""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the file format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    add_dummy_prefix: bool
    digest: str

    @property
    def byte_ids(self) -> list[int]:
        """For each byte value the id of its piece; empty without byte fallback."""
        by_name = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] == BYTE}
        names = [f"<0x{b:02X}>" for b in range(256)]
        return [by_name[n] for n in names] if all(n in by_name for n in names) else []

    @property
    def unknown_id(self) -> int:
        return self.kinds.index(UNKNOWN)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(field number, value) of a protocol-buffers message; 4- and 8-byte values and messages as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({5: 4, 1: 8}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(path: str = DEFAULT_MODEL) -> Vocabulary:
    """The pieces of a SentencePiece model file, with log scores.

    A unigram model's scores are log probabilities already. A BPE model's scores only order its pieces, so each gets the
    log probability of its place in that order under Zipf's law, rounded to 32 bits as in a file."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, model, prefix = [], [], [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own.get(2, bytes(4)))[0])
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            model = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            prefix = bool(dict(_fields(value)).get(3, 1))
    if model != UNIGRAM:
        order = sorted((k for k in range(len(pieces)) if kinds[k] in (NORMAL, USER_DEFINED)), key=lambda k: (-scores[k], k))
        total = math.log(sum(1 / r for r in range(1, len(order) + 1)))
        for rank, k in enumerate(order, 1):
            scores[k] = struct.unpack("<f", struct.pack("<f", -math.log(rank) - total))[0]
    return Vocabulary(pieces, scores, kinds, prefix, hashlib.sha256(data).hexdigest())


@dataclass(frozen=True)
class Trie:
    """A double array: the child of node s by byte b is base[s] + b if check of that is s. value: the key's number or -1."""

    base: list[int]
    check: list[int]
    value: list[int]


def build_trie(keys: dict[bytes, int]) -> Trie:
    """keys: non-empty byte strings and their numbers. Node 0 is the root."""
    ordered = sorted(keys)
    size = max(1024, 4 * sum(map(len, ordered)) // 3)
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    lowest = 1
    todo = [(0, 0, len(ordered), 0)]
    while todo:
        node, lo, hi, depth = todo.pop()
        if lo < hi and len(ordered[lo]) == depth:
            value[node] = keys[ordered[lo]]
            lo += 1
        groups: list[tuple[int, int, int]] = []
        at = lo
        while at < hi:
            byte, end = ordered[at][depth], at
            while end < hi and ordered[end][depth] == byte:
                end += 1
            groups.append((byte, at, end))
            at = end
        if not groups:
            base[node] = -size  # no child: all its places lie below 0
            continue
        codes = [g[0] for g in groups]
        place, tried = max(lowest, codes[0] + 1), 0
        while True:
            if place + 256 >= len(check):
                more = len(check)
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
            if check[place] < 0:
                start = place - codes[0]
                if all(check[start + c] < 0 for c in codes):
                    break
                tried += 1
            place += 1
        if tried > 64:  # the part below is nearly full
            lowest = max(lowest, place - 256)
        while check[lowest] >= 0:
            lowest += 1
            if lowest + 256 >= len(check):
                break
        base[node] = start
        for c, a, b in groups:
            check[start + c] = node
            todo.append((start + c, a, b, depth + 1))
    used = max(k for k in range(len(check)) if check[k] >= 0) + 257
    leaf = -(used + 1)
    return Trie([leaf if x == -size else x for x in base[:used]] + [leaf] * max(0, used - len(base)), (check + [-1] * used)[:used], (value + [-1] * used)[:used])
