"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets a failure link for each node: where matching goes on once the tokens that are certain by then
are popped, and how many these are. A word's greedy longest-match length then takes one step for each byte plus one for
each pop, and no piece is built. A word stands for U+2581 and its characters, so that first pieces and others differ.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import once, small_batches
from .vocabulary import DEFAULT_MODEL, NORMAL, SPACE, USER_DEFINED, Vocabulary, build_trie, read_model

REMEMBERED, LONGEST = 400_000, 64
#: What a word counts that the vocabulary can't spell.
UNKNOWN_WORD_TOKENS = 1


class Automaton:
    def __init__(self, keys: list[bytes]) -> None:
        trie = build_trie({k: n for n, k in enumerate(keys)})
        self.base, self.check = trie.base, trie.check
        n = len(self.check)
        #: -1: no way on, the word can't be spelt.
        self.fail, self.popped = [-1] * n, [0] * n
        children: dict[int, list[int]] = {}
        for node, parent in enumerate(self.check):
            if parent >= 0 and node:
                children.setdefault(parent, []).append(node)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for node in children.get(parent, ()):
                queue.append(node)
                if trie.value[node] >= 0:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                byte, to, count = node - self.base[parent], self.fail[parent], self.popped[parent]
                while to >= 0:
                    child = self.base[to] + byte
                    if child >= 0 and self.check[child] == to:
                        self.fail[node], self.popped[node] = child, count
                        break
                    count += self.popped[to]
                    to = self.fail[to]

    def count(self, word: bytes) -> int:
        """Tokens of the greedy longest-match split, or -1 if there is none."""
        base, check, fail, popped = self.base, self.check, self.fail, self.popped
        node = tokens = 0
        for byte in word:
            child = base[node] + byte
            while child < 0 or check[child] != node:
                to = fail[node]
                if to < 0:
                    return -1
                tokens += popped[node]
                node = to
                child = base[node] + byte
            node = child
        while node:
            if fail[node] < 0:
                return -1
            tokens += popped[node]
            node = fail[node]
        return tokens


def automaton(vocabulary: Vocabulary) -> Automaton:
    return Automaton([p.encode() for p, kind in zip(vocabulary.pieces, vocabulary.kinds, strict=True) if kind in (NORMAL, USER_DEFINED) and p])


def count_tokens(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_tokens and n_unknown_words (long).

    Words are the runs without ASCII white space. A word that can't be spelt counts UNKNOWN_WORD_TOKENS. Null and empty
    texts count 0. Columns of docs with the names of results are replaced. The automaton is built on the driver and sent: its
    size is the vocabulary's."""
    vocabulary = read_model(model)
    made, key = docs.sparkSession.sparkContext.broadcast(automaton(vocabulary)), f"counts {vocabulary.digest}"
    names = ("n_words", "n_tokens", "n_unknown_words")
    rest = [f for f in docs.schema.fields if f.name not in (*names, text)]
    first = SPACE.encode()

    def run(batches):
        machine, known = once(key, lambda: (made.value, {}))

        def look_up(word: bytes) -> int:
            found = known.get(word)
            if found is None:
                found = machine.count(first + word)
                if len(word) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = found
            return found

        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for x in batch.column(len(rest)):
                counts = list(map(look_up, x.as_buffer().to_pybytes().split())) if x.is_valid else []
                unknown = counts.count(-1)
                for column, v in zip(out, (len(counts), sum(counts) + unknown * (1 + UNKNOWN_WORD_TOKENS), unknown), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *(pa.array(v, pa.int64()) for v in out)], names=[*(f.name for f in rest), *names])

    return small_batches(docs.select(*(f.name for f in rest), text)).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{n} long" for n in names)]))
