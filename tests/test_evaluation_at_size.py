"""The steps that evaluation and chunk queries share: what they write, what they shuffle, and that their rows are whole."""

import random

import pytest

from gleanery.operators import evaluation, intervals, search_index
from gleanery.operators import keyword_search as ks
from gleanery.plans import evaluation as plans


def test_quotes_are_found_as_bytes(spark):
    """Texts of many widths of characters, beginnings that questions share, places at both ends, and none across two rows."""
    assert ks.PLACES > 8
    rng, letters = random.Random(3), "aé ßñ日😀."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    asked = [t[a : a + n] for t in texts for a, n in ((0, 9), (len(t) // 2, 12), (max(0, len(t) - 30), 30)) if t] + ["aaaaaaaaa", "aé ßñ日😀.", "a", "😀"]
    texts += [None, "", "aaaaaaaaaa" * 3, "x", asked[0][:5], asked[0][5:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    found = ks.quotes(q, docs)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.qid, r.id, r.start, r.end) for r in found.collect())
    assert got == sorted((n, d, at, at + len(own)) for n, own in enumerate(asked) for d, t in enumerate(texts) if t is not None and own for at in range(len(t)) if t.startswith(own, at))


def test_index_for_a_batch_gives_the_same_hits(spark, tmp_path):
    texts = ["net sales rose", "sales of net assets, net of tax", "", None, "other words", "net net net sales"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(1, "net sales"), (2, "tax on assets"), (3, "absent")], "qid long, question string")
    search_index.write_for(docs, f"{tmp_path}/own", ["net", "sales", "tax", "on", "assets", "absent"])
    own = search_index.stored(spark, f"{tmp_path}/own")
    assert "positions" not in own.rows.columns and own.n == 6
    assert {r.lexeme: r.df for r in own.lexemes.collect()} == {"net": 3, "sales": 3, "tax": 1, "assets": 1}
    rows = [sorted((r.qid, r.id, r.rank, round(r.score, 9)) for r in ks.bm25(q, s, 4).collect()) for s in (own, docs)]
    assert rows[0] == rows[1] and len(rows[0]) == 4
    with pytest.raises(ValueError):
        search_index.document_rows(docs, only=["net"])


def test_chunk_texts_are_not_stored(spark, sf_dir):
    assert plans.chunks(spark, sf_dir).columns == ["id", "doc", "char_start", "char_end"]
    assert "positions" not in plans.chunk_index(spark, sf_dir).rows.columns


def test_marks_of_other_keys_are_not_sorted(spark):
    points = spark.createDataFrame([(1, 5), (2, 0), (3, 1)], "doc long, at int")
    marks = spark.range(1000).selectExpr("id % 100 AS doc", "int(id / 100) AS start", "id").where("doc <> 3")
    found = intervals.as_of(points, marks, "doc", "at", "start", ["id"])
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc, r.at, r.id) for r in found.collect() if r.doc < 3) == [(1, 5, 501), (2, 0, 2)]
    assert [r.id for r in found.where("doc = 3").collect()] == [None]


def test_ideal_gain_keeps_few_rows_a_task(spark):
    rows = spark.range(5000).selectExpr("id % 2 AS qid", "int(id % 3) AS grade")
    found = evaluation.ideal_dcg(rows)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert all(abs(r["idcg@3"] - (3 + 3 / 1.5849625007 + 1.5)) < 1e-6 for r in found.collect()) and found.count() == 2
