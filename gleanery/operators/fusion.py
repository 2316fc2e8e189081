"""Rank fusion of several result lists, and re-ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexemes
from ..settings import FILTER_MODES, MODES, Settings, one_of
from .ranking import ranked, top_k


def union_of(lists: list[DataFrame]) -> DataFrame:
    """qid, id, score, rank, list_no of all lists."""
    return reduce(DataFrame.unionByName, [x.select("qid", "id", "score", "rank").withColumn("list_no", F.lit(n)) for n, x in enumerate(lists)])


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """qid, id, score, rank, best_rank, best_list: the sum of 1 / (k + rank); ties by the best single rank, then id."""
    rows = union_of(lists).groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("rank", "list_no")).alias("_best"))
    rows = rows.select("qid", "id", "score", F.col("_best.rank").alias("best_rank"), F.col("_best.list_no").alias("best_list"))
    return ranked(rows, ["qid"], [F.round("score", 9).desc(), F.col("best_rank"), F.col("id")])


def weighted(lists: list[DataFrame], weights: list[float]) -> DataFrame:
    """qid, id, score, rank: each list's scores scaled to 0..1 (all 1 if they are equal), times its weight, summed."""
    if len(lists) != len(weights):
        raise ValueError("as many weights as lists")
    own = Window.partitionBy("qid", "list_no")
    rows = union_of(lists).withColumns({"_lo": F.min("score").over(own), "_hi": F.max("score").over(own)})
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    rows = rows.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("list_no")))
    rows = rows.groupBy("qid", "id").agg(F.sum(scaled * F.col("_w")).alias("score"))
    return ranked(rows, ["qid"], [F.round("score", 9).desc(), F.col("id")])


def cut(rows: DataFrame, k: int) -> DataFrame:
    return rows.where(F.col("rank") <= k)


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Both legs, each filtered alike and cut at its depth already, fused and cut at k. One plan: the legs may run at once."""
    return cut(rrf([vector_hits, keyword_hits], rrf_k), k)


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct lexemes that the text has: the scorer used where no model is at hand."""
    words = F.array_distinct(lexemes(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words, lexemes(text))).cast("double"), F.size(words).cast("double")), F.lit(0.0))


def rerank(hits: DataFrame, questions: DataFrame, texts: DataFrame, k: int, n: int, scorer=lexical_overlap) -> DataFrame:
    """qid, id, score, rank, first_rank: the first max(n, k) hits scored anew; ties keep their order."""
    rows = hits.where(F.col("rank") <= max(n, k)).select("qid", "id", F.col("rank").alias("first_rank"))
    # The hits are few: texts stay where they are.
    rows = texts.select("id", "text").join(F.broadcast(rows), "id").join(questions.select("qid", "question"), "qid").withColumn("score", scorer(F.col("question"), F.col("text")))
    return cut(ranked(rows, ["qid"], [F.round("score", 9).desc(), F.col("first_rank")]), k).select("qid", "id", "score", "rank", "first_rank")


def retriever(mode: str, questions: DataFrame, source, vectors: DataFrame, k: int, depth: int = 50, rrf_k: int = 60, *, rank_function: str | None = None, phrases: bool | None = None, analyser: str | None = None, vector_filter: Column | None = None, among: DataFrame | None = None, filter_mode: str | None = None, candidates: int | None = None) -> DataFrame:
    """Hits by the named mode. questions: qid, question, qvec. source: an index, or docs (doc_id, text). vectors: vec_id,
    embedding and what vector_filter reads. among: the rows (doc_id) that pass the same filter.

    Both legs of hybrid are filtered alike, each before it is cut at `depth`. Options that the mode doesn't read are errors.
    filter_mode: exact and iterative search among the filtered vectors, post filters the first `candidates` of all."""
    from .keyword_search import ranked_by
    from .vector_search import exact_top_k, post_filtered_top_k

    one_of("mode", mode, MODES)
    unread = {"vector": {"rank_function": rank_function, "phrases": phrases, "analyser": analyser, "among": among}, "keyword": {"vector_filter": vector_filter, "filter_mode": filter_mode, "candidates": candidates}}.get(mode, {})
    if wrong := [name for name, value in unread.items() if value is not None]:
        raise ValueError(f"mode {mode} takes no {', '.join(wrong)}")
    if mode == "hybrid" and (vector_filter is None) != (among is None):
        raise ValueError("both legs are filtered, or neither")

    def by_vector(n: int) -> DataFrame:
        if vector_filter is not None and one_of("filter_mode", filter_mode or "exact", FILTER_MODES) == "post":
            return post_filtered_top_k(questions, vectors, n, candidates or 4 * n, vector_filter)
        return exact_top_k(questions, vectors if vector_filter is None else vectors.where(vector_filter), n)

    def by_keyword(n: int) -> DataFrame:
        return ranked_by(rank_function or "ts_rank")(questions, source, n, among=among, analyser=analyser or "plain", phrases=bool(phrases))

    if mode == "hybrid":
        return hybrid(by_vector(depth), by_keyword(depth), k, rrf_k)
    return by_vector(k) if mode == "vector" else by_keyword(k)


def configured(settings: Settings, questions: DataFrame, source, vectors: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Hits by the settings' mode and rank function, re-ranked if they say so: the first stage then finds
    max(rerank_n, top_k). texts: doc_id, text, where source is an index."""
    own = {} if settings.mode == "vector" else {"rank_function": settings.rank_function, "phrases": True}
    first = retriever(settings.mode, questions, source, vectors, max(settings.rerank_n, settings.top_k) if settings.rerank else settings.top_k, settings.depth, settings.rrf_k, **own)
    if not settings.rerank:
        return first
    docs = source if texts is None else texts
    return rerank(first, questions, docs.select(F.col("doc_id").alias("id"), "text"), settings.top_k, settings.rerank_n)


__all__ = ["configured", "cut", "hybrid", "lexical_overlap", "rerank", "retriever", "rrf", "top_k", "union_of", "weighted"]
