"""Registered queries: vector and keyword search, fusion, re-ranking, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexemes, split_query
from ..operators import fusion, search_index, vector_search
from ..operators import keyword_search as ks
from ..settings import Settings
from ..sources.stored import folder_once
from ..sources.tables import table

K, DEPTH, LABELS, CANDIDATES = 10, 50, (1, 3, 5), 100


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).join(vectors(spark, d).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def index(spark: SparkSession, d: str, analyser: str = "plain") -> search_index.Index:
    """The stored index of the documents: made by the first query of a session, then only read."""
    folder = folder_once(spark, (d, "documents", analyser), lambda f: search_index.refresh(documents(spark, d), f, analyser=analyser))
    return search_index.stored(spark, folder, analyser)


def lists(spark: SparkSession, d: str, n: int = 16):
    return vector_search.stored_lists(spark, folder_once(spark, (d, "lists", n), lambda f: vector_search.build_lists(vectors(spark, d), f, n)))


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def vector_topk_exact(spark, d):
    return shown(vector_search.exact_top_k(query_vectors(spark, d), vectors(spark, d), K))


def vector_topk_expression(spark, d):
    return shown(vector_search.by_expression(query_vectors(spark, d), vectors(spark, d), K))


def vector_topk_filtered(spark, d):
    return shown(vector_search.exact_top_k(query_vectors(spark, d), vectors(spark, d).where(F.col("label").isin(*LABELS)), K))


def vector_topk_postfilter(spark, d):
    return shown(vector_search.post_filtered_top_k(query_vectors(spark, d), vectors(spark, d), K, CANDIDATES, F.col("label").isin(*LABELS)))


def vector_l2_topk(spark, d):
    return shown(vector_search.exact_top_k(query_vectors(spark, d), vectors(spark, d), K, metric="l2"))


def vector_inner_product_topk(spark, d):
    return shown(vector_search.exact_top_k(query_vectors(spark, d), vectors(spark, d), K, metric="inner_product"))


def vector_binary_rescored(spark, d):
    return shown(vector_search.binary_top_k(query_vectors(spark, d), vectors(spark, d), K))


def ann_recall(spark, d):
    some = vectors(spark, d).where(F.col("label").isin(*LABELS))
    exact = vector_search.exact_top_k(query_vectors(spark, d), some, K)
    found = vector_search.post_filtered_top_k(query_vectors(spark, d), vectors(spark, d), K, CANDIDATES, F.col("label").isin(*LABELS))
    return vector_search.recall(found, exact).select("qid", F.round("recall", 6).alias("recall"))


def ivf_recall(spark, d):
    """Recall of the stored inverted lists, 12 of 16 probed."""
    indexed, centre = lists(spark, d)
    found = vector_search.probed_top_k(query_vectors(spark, d), indexed, centre, K, 12)
    return vector_search.recall(found, vector_search.exact_top_k(query_vectors(spark, d), vectors(spark, d), K))


def vector_topk_iterative(spark, d):
    """A filter that few rows pass, probed until ten do: queries that found fewer have read every list."""
    indexed, centre = lists(spark, d)
    found = vector_search.iterative_top_k(query_vectors(spark, d), indexed, centre, K, 2, F.col("label") == LABELS[0])
    return found.groupBy("qid").agg(F.count("*").alias("n"), F.max("rank").alias("last"))


def half_precision_recall(spark, d):
    v = vectors(spark, d)
    half = v.withColumn("embedding", vector_search.half_precision(F.col("embedding")))
    return vector_search.recall(vector_search.exact_top_k(query_vectors(spark, d), half, K), vector_search.exact_top_k(query_vectors(spark, d), v, K))


def lexeme_stats(spark, d):
    return ks.lexeme_stats(documents(spark, d))


def stored_lexeme_stats(spark, d):
    """The statistics that the index holds."""
    return index(spark, d).lexemes.select("lexeme", "df")


def index_refresh(spark, d):
    """An index of the same rows isn't written again; one more row, or another text, is reason to."""
    docs = documents(spark, d).where("doc_id < 50").select("doc_id", "text")
    changes = [("same", docs), ("text", docs.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))), ("row", docs.unionByName(spark.sql("SELECT 1000000L AS doc_id, 'more' AS text")))]
    out = []
    for name, rows in changes:
        folder = folder_once(spark, (d, "refresh", name), lambda f: search_index.refresh(docs, f))
        out.append((name, search_index.refresh(rows, folder)))
        search_index.refresh(docs, folder)
    return spark.createDataFrame(out, "change string, refreshed boolean")


def chunk_set_stats(spark, d):
    own = index(spark, d)
    return spark.range(1).select(F.lit(own.n).alias("n_chunks"), F.round(F.lit(own.mean), 6).alias("avg_length"))


def or_match_count(spark, d):
    return ks.match_counts(questions(spark, d), index(spark, d))


def bm25_topk(spark, d):
    return shown(ks.bm25(questions(spark, d), index(spark, d), K))


def bm25_unstored_topk(spark, d):
    """Without a stored index: postings from the documents, for one search."""
    return shown(ks.bm25(questions(spark, d), documents(spark, d), K))


def some_documents(spark, d) -> DataFrame:
    return documents(spark, d).where(F.col("lang").isin("en") & F.col("source").isin("src0", "src1", "src2"))


def bm25_topk_filtered(spark, d):
    return shown(ks.bm25(questions(spark, d), index(spark, d), K, among=some_documents(spark, d)))


def phrased_questions(spark, d) -> DataFrame:
    """The items with their third and fourth lexemes quoted, which a hit must have side by side."""
    words = lexemes(F.col("question"))
    return questions(spark, d).where(F.size(words) >= 4).withColumn("question", F.concat(F.col("question"), F.lit(' "'), F.array_join(F.slice(words, 3, 2), " "), F.lit('"')))


def bm25_phrase_topk(spark, d):
    return shown(ks.bm25(phrased_questions(spark, d), index(spark, d), K, phrases=True))


def ts_rank_phrase_topk(spark, d):
    return shown(ks.ts_rank(phrased_questions(spark, d), index(spark, d), K, phrases=True))


def ts_rank_topk(spark, d):
    return shown(ks.ts_rank(questions(spark, d), index(spark, d), K))


def cover_density_topk(spark, d):
    return shown(ks.cover_density(questions(spark, d), index(spark, d), K))


def stemmed_bm25_topk(spark, d):
    """BM25 by the English analyser: stop words keep their places, the other words are stemmed."""
    return shown(ks.bm25(questions(spark, d), index(spark, d, "english"), K))


def phrase_match(spark, d):
    """Documents that have the second to sixth lexemes of an item side by side."""
    phrases = questions(spark, d).withColumn("phrases", F.array(F.array_join(F.slice(lexemes(F.col("question")), 2, 5), " ")))
    return ks.phrase_matches(phrases, index(spark, d))


def query_split(spark, d):
    rows = spark.sql(QUERY_FIXTURES)
    phrases, rest = split_query(F.col("question"))
    return rows.select("qid", F.array_join(phrases, " / ").alias("phrases"), F.trim(F.regexp_replace(rest, " +", " ")).alias("rest"))


def lists_of(spark, d):
    q = question_vectors(spark, d)
    return vector_search.exact_top_k(q, vectors(spark, d), DEPTH), ks.bm25(q, index(spark, d), DEPTH)


def rrf_fusion(spark, d):
    return fusion.rrf(list(lists_of(spark, d))).select("qid", "id", F.round("score", 6).alias("score"), "rank", "best_rank", "best_list")


def weighted_fusion(spark, d):
    return shown(fusion.weighted(list(lists_of(spark, d)), [0.7, 0.3]))


def hybrid_topk(spark, d):
    return shown(fusion.hybrid(*lists_of(spark, d), K))


def rerank_overlap(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    first = ks.bm25(questions(spark, d), index(spark, d), 20)
    return fusion.rerank(first, questions(spark, d), docs, K, 20).select("qid", "id", F.round("score", 6).alias("score"), "rank", "first_rank")


def retriever_filtered(spark, d):
    """Hybrid retrieval from the factory, both legs filtered alike before they are cut."""
    v = vectors(spark, d).join(documents(spark, d).select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id")
    keep = F.col("lang").isin("en") & F.col("source").isin("src0", "src1", "src2")
    return shown(fusion.retriever("hybrid", question_vectors(spark, d), index(spark, d), v, K, DEPTH, rank_function="bm25", vector_filter=keep, among=some_documents(spark, d)))


def configured_search(spark, d):
    """The settings' retrieval: hybrid with ts_rank and required phrases, re-ranked."""
    hits = fusion.configured(Settings(rerank_n=20), question_vectors(spark, d), index(spark, d), vectors(spark, d), documents(spark, d))
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank", "first_rank")


QUERY_FIXTURES = """SELECT * FROM (VALUES (1, 'what does "goodwill impairment" mean for 16,434 and 1,234.56?'), (2, 'no phrases here'), (3, '" " and "two words" 404,381'), (4, '12345 and 1,23 stay')) AS t(qid, question)"""

_q = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0)"


def _vector_sql(measure: str, where: str = "TRUE", order: str = "DESC") -> str:
    return f"""WITH {_q}, s AS (SELECT qid, vec_id AS id, {measure} AS sc FROM q, embeddings WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) {order}, id)::INT AS rank FROM s)
SELECT qid, id, round(sc, 6) AS score, rank FROM r WHERE rank <= {K}"""


_COS = "list_cosine_similarity(qv, embedding::DOUBLE[])"
_IN = f"label IN {LABELS}"
_POST = f"""WITH {_q}, s AS (SELECT qid, vec_id AS id, label, {_COS} AS sc FROM q, embeddings),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id) AS near FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id)::INT AS rank FROM c WHERE near <= {CANDIDATES} AND {_IN})
"""
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_BM25 = f"""q AS (SELECT DISTINCT item_id AS qid, unnest({_WORDS}) AS lexeme FROM benchmark),
d AS (SELECT doc_id AS id, lang, source, {_WORDS} AS w FROM documents),
l AS (SELECT id, lang, source, len(list_distinct(w)) AS n FROM d), a AS (SELECT avg(n) AS m, count(*) AS docs FROM l),
p AS (SELECT id, lexeme, count(*) AS tf FROM (SELECT id, unnest(w) AS lexeme FROM d) GROUP BY ALL),
f AS (SELECT lexeme, count(*) AS df FROM p GROUP BY ALL),
bm AS (SELECT qid, id, lang, source, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))) AS sc
       FROM q JOIN p USING (lexeme) JOIN f USING (lexeme) JOIN l USING (id), a GROUP BY ALL)"""


def _bm25_sql(where: str = "TRUE", k: int = K) -> str:
    return f"""WITH {_BM25}, r AS (SELECT qid, id, sc, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id)::INT AS rank FROM bm WHERE {where})
SELECT qid, id, round(sc, 6) AS score, rank FROM r WHERE rank <= {k}"""


_LEGS = f"""WITH {_BM25}, kr AS (SELECT qid, id, sc, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id)::INT AS rank FROM bm),
qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS qv FROM benchmark JOIN embeddings ON vec_id = item_id),
vs AS (SELECT qid, vec_id AS id, {_COS} AS sc FROM qv, embeddings),
vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id)::INT AS rank FROM vs),
u AS (SELECT qid, id, sc, rank, 0 AS list_no FROM vr WHERE rank <= {DEPTH} UNION ALL SELECT qid, id, sc, rank, 1 FROM kr WHERE rank <= {DEPTH}
      AND qid IN (SELECT qid FROM qv)),
f1 AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS sc, min(rank) AS best_rank, arg_min(list_no, rank * 10 + list_no) AS best_list FROM u GROUP BY ALL),
f2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, best_rank, id)::INT AS rank FROM f1)
"""
_TS = "ts AS (SELECT qid, id, lang, source, sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda i: 1.0::DOUBLE / (i * i))) / 1.64493406685) / (1 + ln(any_value(len))) AS sc FROM q JOIN p USING (lexeme) JOIN (SELECT id, lang, source, len(w) AS len FROM d) USING (id) GROUP BY ALL)"
_PHRASED = f"""ph AS (SELECT item_id AS qid, ' ' || array_to_string({_WORDS}[3:4], ' ') || ' ' AS ph FROM benchmark WHERE len({_WORDS}) >= 4),
both_ AS (SELECT qid, id FROM ph JOIN (SELECT id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d) ON contains(t, ph))"""


def _phrase_sql(scores: str) -> str:
    return f"""WITH {_BM25}, {_TS}, {_PHRASED}, r AS (SELECT qid, id, sc, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id)::INT AS rank FROM {scores} SEMI JOIN both_ USING (qid, id))
SELECT qid, id, round(sc, 6) AS score, rank FROM r WHERE rank <= {K}"""


_SOME = "lang = 'en' AND source IN ('src0', 'src1', 'src2')"


def _fused(keyword: str, where: str = "TRUE") -> str:
    """Both legs under a filter, the keyword one by the scores named, fused."""
    legs = _LEGS.replace("FROM bm)", f"FROM {keyword} WHERE {where})").replace(f"WITH {_BM25}", f"WITH {_BM25}, {_TS}")
    return legs if where == "TRUE" else legs.replace("FROM qv, embeddings)", f"FROM qv, embeddings JOIN documents ON doc_id = vec_id WHERE {where})")


QUERIES = {f.__name__: f for f in (vector_topk_exact, vector_topk_expression, vector_topk_filtered, vector_topk_postfilter, vector_l2_topk, vector_inner_product_topk, vector_binary_rescored, ann_recall, ivf_recall, half_precision_recall, lexeme_stats, stored_lexeme_stats, index_refresh, chunk_set_stats, or_match_count, bm25_topk, bm25_unstored_topk, bm25_topk_filtered, bm25_phrase_topk, ts_rank_phrase_topk, vector_topk_iterative, retriever_filtered, configured_search, ts_rank_topk, cover_density_topk, stemmed_bm25_topk, phrase_match, query_split, rrf_fusion, weighted_fusion, hybrid_topk, rerank_overlap)}
ORACLES = {
    "vector_topk_exact": _vector_sql(_COS),
    "vector_topk_expression": _vector_sql(_COS),
    "vector_topk_filtered": _vector_sql(_COS, _IN),
    "vector_l2_topk": _vector_sql("list_distance(qv, embedding::DOUBLE[])", order="ASC"),
    "vector_inner_product_topk": _vector_sql("list_inner_product(qv, embedding::DOUBLE[])"),
    "vector_topk_postfilter": f"{_POST} SELECT qid, id, round(sc, 6) AS score, rank FROM r WHERE rank <= {K}",
    "vector_binary_rescored": f"""WITH {_q}, s AS (SELECT qid, vec_id AS id, {_COS} AS sc, len(list_filter(range(1, len(qv) + 1), lambda i: (qv[i] > 0) <> (embedding[i] > 0))) AS h FROM q, embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h, id) AS near FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id)::INT AS rank FROM n WHERE near <= 40)
SELECT qid, id, round(sc, 6) AS score, rank FROM r WHERE rank <= {K}""",
    "ann_recall": f"""{_POST}, e AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id) AS rank FROM s WHERE {_IN})
SELECT e.qid, round(count(r.id) / count(*), 6) AS recall FROM (SELECT * FROM e WHERE rank <= {K}) e LEFT JOIN (SELECT * FROM r WHERE rank <= {K}) r ON e.qid = r.qid AND e.id = r.id GROUP BY ALL""",
    "lexeme_stats": f"SELECT lexeme, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS lexeme FROM documents) GROUP BY ALL",
    "chunk_set_stats": f"SELECT count(*) AS n_chunks, round(avg(len(list_distinct({_WORDS}))), 6) AS avg_length FROM documents",
    "or_match_count": f"WITH {_BM25} SELECT item_id AS qid, count(DISTINCT id) AS matches FROM benchmark LEFT JOIN bm ON qid = item_id GROUP BY ALL",
    "stored_lexeme_stats": f"SELECT lexeme, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS lexeme FROM documents) GROUP BY ALL",
    "bm25_topk": _bm25_sql(),
    "bm25_unstored_topk": _bm25_sql(),
    "bm25_phrase_topk": _phrase_sql("bm"),
    "ts_rank_phrase_topk": _phrase_sql("ts"),
    "index_refresh": "SELECT unnest(['same', 'text', 'row']) AS change, unnest([false, true, true]) AS refreshed",
    "vector_topk_iterative": f"WITH {_q}, n AS (SELECT count(*) AS n FROM embeddings WHERE label = {LABELS[0]}) SELECT qid, least({K}, n) AS n, least({K}, n)::INT AS last FROM q, n WHERE n > 0",
    "retriever_filtered": f"{_fused('bm', _SOME)} SELECT qid, id, round(sc, 6) AS score, rank FROM f2 WHERE rank <= {K}",
    "configured_search": f"""{_fused('ts')}, qs AS (SELECT qid, list(lexeme) AS ql FROM q GROUP BY ALL),
s2 AS (SELECT f2.qid, f2.id, f2.rank AS first_rank, len(list_intersect(ql, w)) / len(ql) AS sc FROM f2 JOIN qs USING (qid) JOIN d USING (id) WHERE f2.rank <= 20),
x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, first_rank)::INT AS rank FROM s2) SELECT qid, id, round(sc, 6) AS score, rank, first_rank FROM x WHERE rank <= {K}""",
    "bm25_topk_filtered": _bm25_sql("lang = 'en' AND source IN ('src0', 'src1', 'src2')"),
    "ts_rank_topk": f"""WITH {_BM25}, t AS (SELECT id, len(w) AS len FROM d),
s AS (SELECT qid, id, sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda i: 1.0::DOUBLE / (i * i))) / 1.64493406685) / (1 + ln(any_value(len))) AS sc FROM q JOIN p USING (lexeme) JOIN t USING (id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id)::INT AS rank FROM s) SELECT qid, id, round(sc, 6) AS score, rank FROM r WHERE rank <= {K}""",
    "phrase_match": f"""WITH p AS (SELECT item_id AS qid, ' ' || array_to_string({_WORDS}[2:6], ' ') || ' ' AS ph FROM benchmark), d AS (SELECT doc_id AS id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS t FROM documents)
SELECT qid, id FROM p, d WHERE contains(t, ph) AND len(ph) > 2""",
    "query_split": rf"""WITH f AS ({QUERY_FIXTURES}), a AS (SELECT qid, regexp_extract_all(question, '"([^"]*)"', 1) AS quoted, regexp_replace(question, '"([^"]*)"', ' ', 'g') AS rest FROM f),
b AS (SELECT qid, list_concat(quoted, regexp_extract_all(rest, '\b\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?\b')) AS ph, regexp_replace(rest, '\b\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?\b', ' ', 'g') AS rest FROM a)
SELECT qid, array_to_string(list_filter(list_transform(ph, lambda x: trim(x)), lambda x: x <> ''), ' / ') AS phrases, trim(regexp_replace(rest, ' +', ' ', 'g')) AS rest FROM b""",
    "rrf_fusion": f"{_LEGS} SELECT qid, id, round(sc, 6) AS score, rank, best_rank, best_list FROM f2",
    "hybrid_topk": f"{_LEGS} SELECT qid, id, round(sc, 6) AS score, rank FROM f2 WHERE rank <= {K}",
    "weighted_fusion": f"""{_LEGS}, w AS (SELECT qid, id, list_no, CASE WHEN max(sc) OVER o > min(sc) OVER o THEN (sc - min(sc) OVER o) / (max(sc) OVER o - min(sc) OVER o) ELSE 1 END AS s FROM u WINDOW o AS (PARTITION BY qid, list_no)),
g AS (SELECT qid, id, sum(s * CASE list_no WHEN 0 THEN 0.7 ELSE 0.3 END::DOUBLE) AS sc FROM w GROUP BY ALL)
SELECT qid, id, round(sc, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id)::INT AS rank FROM g""",
    "rerank_overlap": f"""WITH {_BM25}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, id)::INT AS first_rank FROM bm),
qs AS (SELECT qid, list(lexeme) AS ql FROM q GROUP BY ALL), s AS (SELECT r.qid, r.id, first_rank, len(list_intersect(ql, w)) / len(ql) AS sc FROM r JOIN qs USING (qid) JOIN d USING (id) WHERE first_rank <= 20),
x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, first_rank)::INT AS rank FROM s) SELECT qid, id, round(sc, 6) AS score, rank, first_rank FROM x WHERE rank <= {K}""",
}
