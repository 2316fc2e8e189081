"""Summaries, paired tests, bootstrap intervals, judge verdicts, ablation grids."""

from __future__ import annotations

import random
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.numbers import binomial_p, percentile_cont
from ..settings import MODES, STRATEGIES

# Sizes of the ablation grid, and its extra configurations.
GRID_SIZES = (128, 256, 510)
GRID_EXTRAS = ("structure256-hybrid-rr-bm25", "structure256-keyword-norr-bm25", "structure256-hybrid-rr-n20")
BASELINE = "structure256-hybrid-rr"
VERDICTS = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}


def long_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return rows.select(*keys, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)"))


def summaries(rows: DataFrame, metrics: list[str], kind: str = "type") -> DataFrame:
    """kind (null: all kinds together), metric, n, mean over rows with a value: one pass."""
    long = long_metrics(rows, [kind], metrics).where("value IS NOT NULL")
    both = long.groupingSets([[F.col(kind), F.col("metric")], [F.col("metric")]], kind, "metric")
    return both.agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sign_test(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """by, wins (a above b), losses, p: exact, two-sided; ties and rows without both values don't count."""
    counts = pairs.groupBy(*by).agg(F.count_if(F.col(a) > F.col(b)).alias("wins"), F.count_if(F.col(a) < F.col(b)).alias("losses"))
    return counts.withColumn("p", binomial_p(F.col("wins"), F.col("losses")))


def bootstrap_interval(rows: DataFrame, by: list[str], value: str, resamples: int = 2000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """by, lo, hi: the percentile interval of the mean, drawing with the Mersenne Twister; null without values.

    rows: `order` fixes the sequence of a group's values. A group is one configuration's questions."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def interval(lists: pd.Series) -> pd.Series:
        def one(values):
            xs = [float(x) for x in values]
            if not xs:
                return [None, None]
            rng = random.Random(seed)
            means = sorted(sum(xs[rng.randrange(len(xs))] for _ in xs) / len(xs) for _ in range(resamples))
            return [means[int(alpha / 2 * resamples)], means[int((1 - alpha / 2) * resamples) - 1]]

        return lists.map(one)

    lists = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("order", F.col(value).cast("double").alias("v")))).alias("_l"))
    return lists.select(*by, interval(F.transform("_l", lambda x: x["v"])).alias("_i")).select(*by, F.get("_i", 0).alias("lo"), F.get("_i", 1).alias("hi"))


def grid(spark) -> DataFrame:
    """config, strategy, size, overlap, mode, rerank: every combination, and the extra configurations."""
    rows = [(f"{s}{n}-{m}-{'rr' if r else 'norr'}", s, n, n // 8, m, r) for s, n, m, r in product(STRATEGIES, GRID_SIZES, MODES, (True, False))]
    rows += [(x, "structure", 256, 32, x.split("-")[1], "-rr" in x) for x in GRID_EXTRAS]
    return spark.createDataFrame(rows, "config string, strategy string, size int, overlap int, mode string, rerank boolean")


def pending(configs: DataFrame, results: DataFrame) -> DataFrame:
    """Configurations without a result for the same label hash: config, label_sha."""
    return configs.join(results.select("config", "label_sha"), ["config", "label_sha"], "left_anti")


def against_baseline(rows: DataFrame, baseline: str, metric: str) -> DataFrame:
    """config, wins, losses, p: each configuration's questions paired with the baseline's."""
    base = rows.where(F.col("config") == baseline).select("qid", F.col(metric).alias("b"))
    return sign_test(rows.select("config", "qid", F.col(metric).alias("a")).join(base, "qid"), ["config"])


def ablation_table(rows: DataFrame, baseline: str, metrics: list[str], paired: str) -> DataFrame:
    means = rows.groupBy("config").agg(*[F.avg(m).alias(m) for m in metrics])
    return means.join(against_baseline(rows, baseline, paired), "config", "left")


def quality_scores(judgements: DataFrame) -> DataFrame:
    """Of judges' JSON replies: faithfulness (share of claims supported, null without claims), relevance ((score - 1) / 4,
    clamped), correctness by verdict. faithfulness_json, relevance_json, correctness_json -> numbers, null if unreadable."""
    claims = F.from_json("faithfulness_json", "claims array<struct<supported:boolean>>")["claims"]
    supported = F.size(F.filter(claims, lambda c: F.coalesce(c["supported"], F.lit(False))))
    score = F.from_json("relevance_json", "score int")["score"]
    verdict = F.from_json("correctness_json", "verdict string")["verdict"]
    table = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])
    return judgements.select("*", F.when(F.size(claims) > 0, supported / F.size(claims)).alias("faithfulness"), ((F.least(F.lit(5), F.greatest(F.lit(1), score)) - 1) / 4).alias("relevance"), F.try_element_at(table, verdict).alias("correctness"))


def hit_rates(rows: DataFrame, by: list[str], hit: str = "hit") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.col(hit).cast("int")).alias("hit_rate"), F.count("*").alias("n"))


def overlap_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a), F.col(b)
    return rows.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def rare_figures(chunks: DataFrame, most: int = 2, pattern: str = r"\b\d{1,3}(?:,\d{3})+\b", seed: int = 7) -> DataFrame:
    """figure, n, draw: figures in `most` chunks at most, with a number that puts them in a pseudorandom, fixed order."""
    figures = chunks.select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("figure"))
    return figures.groupBy("figure").agg(F.count_distinct("id").alias("n")).where(F.col("n") <= most).withColumn("draw", F.sha2(F.concat("figure", F.lit(f"#{seed}")), 256))


def latency_marks(events: DataFrame) -> DataFrame:
    """request_id, first_sources, first_delta, end: the first of each kind and the last event."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    return events.groupBy("request_id").agg(first("sources").alias("first_sources"), first("delta").alias("first_delta"), F.max("ts").alias("end"))


def newest_run(runs: DataFrame) -> DataFrame:
    """One run: the newest with retrieval and judgements, else the newest with retrieval, else the newest."""
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("retrieval") & F.col("judged")), F.desc("retrieval"), F.desc("stamp")))
    return runs.withColumn("_r", rank).where("_r = 1").drop("_r")


def answer_summary(answers: DataFrame) -> DataFrame:
    """One row on a run of answers: n_packed, n_dropped, tokens, refusal_reason, n_invalid, n_uncited, list_usd."""
    return answers.agg(F.count("*").alias("n"), F.sum("n_packed").alias("packed"), F.sum("n_dropped").alias("dropped"), percentile_cont("tokens", 0.5).alias("tokens_median"), F.max("tokens").alias("tokens_max"), F.count("refusal_reason").alias("refusals"), F.sum("n_invalid").alias("invalid"), F.sum("n_uncited").alias("uncited"), F.sum("list_usd").alias("list_usd"))
