"""The index's words, found in bytes, are those of the expression that splits questions."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.functions.text import lexemes
from gleanery.operators import search_index


def test_words_are_those_of_the_expression(spark, monkeypatch):
    monkeypatch.setattr(search_index, "SLICE_BYTES", 64)
    rng, letters = random.Random(5), "abAB1_é日٣²İΣσ  \t\n.,-😀ⅷ𝒜́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "the net", "net", "ascii only, 2 words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {r.doc_id: r.w for r in docs.select("doc_id", lexemes(F.col("text")).alias("w")).collect()}
    for r in search_index.document_rows(docs).collect():
        own = wanted[r.id]
        assert dict(zip(r.lexemes, r.positions, strict=True)) == {w: [n + 1 for n, x in enumerate(own) if x == w] for w in own}
        assert (r.length, r.total, r.tfs) == (len(set(own)), len(own), [own.count(w) for w in r.lexemes])
    # Words are not taken from a column of words, made by the expression a text at a time.
    assert "regexp_extract_all" not in search_index.document_rows(docs)._jdf.queryExecution().optimizedPlan().toString()


def test_words_end_with_their_text(spark):
    found = search_index.words_of(pa.array(["", "ab", "cd e", "é", ""]).slice(1), search_index.letters_of(spark))
    assert found.to_pylist() == [["ab"], ["cd", "e"], ["é"], []]
