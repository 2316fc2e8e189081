"""Words as numbers, and hashes of all windows of words of a text at once, with numpy.

A word's number is its XXH3 hash under a seed. A window's hash is a polynomial in these numbers modulo 2**64 at an odd base
that the seed gives too; prefix sums give every window's in two look-ups. Hashes choose candidates only: a clash costs a
comparison, and what is removed or linked is decided by cryptographic digests of the words or by the words themselves.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import repeat

import numpy as np
from xxhash import xxh3_64_intdigest

_BLANKS = bytes(range(9, 14))
TO_BLANK = bytes(32 if b in _BLANKS else b for b in range(256))
TO_LOWER_BLANK = bytes(32 if b in _BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def joined_words(text: bytes, lower: bool = False) -> bytes:
    """The words of the text (A to Z in lower case if asked for), one blank between two."""
    return b" ".join(text.translate(TO_LOWER_BLANK if lower else TO_BLANK).split())


def word_edges(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of joined_words, as a uint8 array."""
    if not joined.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(joined == 32)
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [joined.size]])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_numbers(words: list[bytes], seed: int) -> np.ndarray:
    """A 64-bit number of each word."""
    return np.fromiter(map(xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words))


class WindowHash:
    """Hashes of all windows of a number of words. The tables of powers grow to the longest text met."""

    def __init__(self, key: bytes) -> None:
        self.seed = int.from_bytes(key[:8], "little")
        self.base = int.from_bytes(blake2b(b"base", digest_size=8, salt=key).digest(), "little") | 3
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        def powers(of: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while out.size < n:
                out = np.concatenate([out, out * np.uint64(pow(of, out.size, 1 << 64))])
            return out

        self.powers, self.inverses = powers(self.base), powers(pow(self.base, -1, 1 << 64))

    def windows(self, words: list[bytes], size: int) -> np.ndarray:
        """A 64-bit hash of each run of `size` words: depends on the words alone, not on their place."""
        n = len(words) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        if self.powers.size < len(words):
            self._grow(max(1 << 12, len(words)))
        upto = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(word_numbers(words, self.seed) * self.powers[: len(words)], out=upto[1:])
        return mixed((upto[size:] - upto[:n]) * self.inverses[:n])
