"""Span-graded retrieval metrics over questions and configurations at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def span_grade(chunk_start: Column, chunk_end: Column, start: Column, end: Column) -> Column:
    """2 if the chunk covers the quote, 1 if it covers half of it, else 0. Of one document, by the caller's join."""
    own, size = overlap(chunk_start, chunk_end, start, end), end - start
    return F.when((own <= 0) | (size <= 0), 0).when(own >= size, 2).when(2 * own >= size, 1).otherwise(0)


def item_grades(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """qid, rank, item, grade above 0: the best alternative of each item for each hit.

    hits: qid, rank, doc, char_start, char_end. spans: qid, item, doc, start, end."""
    s = spans.select(F.col("qid").alias("_q"), "item", F.col("doc").alias("_d"), "start", "end")
    pairs = hits.join(s, (hits["qid"] == F.col("_q")) & (hits["doc"] == F.col("_d")) & (F.col("start") < hits["char_end"]) & (F.col("end") > hits["char_start"]))
    graded = pairs.withColumn("grade", span_grade(F.col("char_start"), F.col("char_end"), F.col("start"), F.col("end")))
    return graded.groupBy("qid", "rank", "item").agg(F.max("grade").alias("grade")).where("grade > 0")


def hit_grades(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """hits with grade: the best over all items, 0 if none."""
    best = item_grades(hits, spans).groupBy("qid", "rank").agg(F.max("grade").alias("grade"))
    return hits.join(best, ["qid", "rank"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def ideal_dcg(grades: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """qid, idcg@k: of the grades of every relevant chunk of the set (qid, grade), best first."""
    ranked = grades.where("grade > 0").withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade")))).where(F.col("_rn") <= max(cuts))
    return ranked.groupBy("qid").agg(*[F.sum(F.when(F.col("_rn") <= k, gain(F.col("grade"), F.col("_rn"))).otherwise(0.0)).alias(f"idcg@{k}") for k in cuts])


def metrics_at(hits: DataFrame, spans: DataFrame, ideal: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """For each question with spans: hit, recall, precision and ndcg at each cut, rr and first_rank of the whole list.

    Precision divides by the cut, also for shorter lists. ideal: qid, grade of the relevant chunks of the set."""
    by_item = item_grades(hits, spans)
    graded = by_item.groupBy("qid", "rank").agg(F.max("grade").alias("grade"))
    dcg = [F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"dcg@{k}") for k in cuts]
    found = [F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)).alias(f"rel@{k}") for k in cuts]
    by_hit = graded.groupBy("qid").agg(*dcg, *found, F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first_rank"))
    items = spans.groupBy("qid").agg(F.count_distinct("item").alias("items"))
    first = by_item.groupBy("qid", "item").agg(F.min("rank").alias("at"))
    covered = first.groupBy("qid").agg(*[F.count_if(F.col("at") <= k).alias(f"cov@{k}") for k in cuts])
    rows = items.join(by_hit, "qid", "left").join(covered, "qid", "left").join(ideal_dcg(ideal, cuts), "qid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = ["qid", "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr")]
    for k in cuts:
        out += [(zero(f"rel@{k}") > 0).cast("int").alias(f"hit@{k}"), (zero(f"cov@{k}") / F.col("items")).alias(f"recall@{k}"), (zero(f"rel@{k}") / F.lit(k)).alias(f"precision@{k}"), F.when(zero(f"idcg@{k}") > 0, zero(f"dcg@{k}") / F.col(f"idcg@{k}")).otherwise(0.0).alias(f"ndcg@{k}")]
    return rows.select(*out)


def average_precision(labels: DataFrame, by: str = "qid") -> DataFrame:
    """by, context_precision: the mean, over relevant ranks, of the share of relevant rows up to them; 0 without any."""
    upto = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = labels.withColumn("_n", F.sum(F.col("relevant").cast("int")).over(upto)).withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy("rank")))
    return rows.groupBy(by).agg(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("_n") / F.col("_i"))), F.lit(0.0)).alias("context_precision"))


def cites_evidence(citations: DataFrame, spans: DataFrame) -> DataFrame:
    """qid, cited_evidence: whether some cited span (qid, rank, doc, char_start, char_end) grades above 0."""
    good = item_grades(citations, spans).select("qid").distinct().withColumn("cited_evidence", F.lit(True))
    return citations.select("qid").distinct().join(good, "qid", "left").select("qid", F.coalesce("cited_evidence", F.lit(False)).alias("cited_evidence"))


def golden_violations(questions: DataFrame, quotes: DataFrame, documents: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """qid, problem. questions: qid, type. quotes: qid, doc, quote. documents: doc, text."""
    twice = questions.groupBy("qid").count().where("count > 1").select("qid", F.lit("duplicate id").alias("problem"))
    kind = questions.where(~F.col("type").isin(list(types))).select("qid", F.lit("unknown type").alias("problem"))
    no_doc = quotes.join(documents, "doc", "left_anti").select("qid", F.lit("unknown document").alias("problem"))
    absent = quotes.join(documents, "doc").where(F.instr("text", F.col("quote")) == 0).select("qid", F.lit("quote not found").alias("problem"))
    lacks = questions.where("type <> 'unanswerable'").join(quotes, "qid", "left_anti").select("qid", F.lit("no evidence").alias("problem"))
    extra = questions.where("type = 'unanswerable'").join(quotes, "qid", "left_semi").select("qid", F.lit("unanswerable with evidence").alias("problem"))
    return reduce(DataFrame.unionByName, [twice, kind, no_doc, absent, lacks, extra]).distinct()


def insert_at_rank_2(hits: DataFrame, poison: DataFrame) -> DataFrame:
    """The poison passages (columns of hits but rank, one for each question and attack) at rank 2, later hits moved on."""
    moved = poison.select("qid", "attack").join(hits, "qid").withColumn("rank", F.when(F.col("rank") >= 2, F.col("rank") + 1).otherwise(F.col("rank"))).withColumn("poison", F.lit(False))
    return moved.unionByName(poison.withColumn("rank", F.lit(2)).withColumn("poison", F.lit(True)), allowMissingColumns=True)


def attack_counts(rows: DataFrame, configs: list[str]) -> DataFrame:
    """attack, n, and for each configuration the number of successes. rows: attack and a boolean column for each."""
    return rows.groupBy("attack").agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in configs])


def detector_counts(rows: DataFrame, detectors: list[str]) -> DataFrame:
    """detector, true_positives, false_positives. rows: is_attack and a boolean column for each detector."""
    pairs = ", ".join(f"'{d}', `{d}`" for d in detectors)
    long = rows.select("is_attack", F.expr(f"stack({len(detectors)}, {pairs}) AS (detector, fired)"))
    return long.groupBy("detector").agg(F.count_if(F.col("fired") & F.col("is_attack")).alias("true_positives"), F.count_if(F.col("fired") & ~F.col("is_attack")).alias("false_positives"))
