"""When to refuse: rates, AUROC, threshold sweep and operating points, for any number of groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio


def rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: refused, answerable (booleans). Null where a denominator is 0."""
    c = lambda x: F.count_if(x)
    refused, good = F.col("refused"), F.col("answerable")
    return rows.groupBy(*by).agg(
        c(good).alias("n_answerable"), c(~good).alias("n_unanswerable"),
        ratio(c(refused & ~good), c(refused)).alias("abstention_precision"), ratio(c(refused & ~good), c(~good)).alias("abstention_recall"),
        ratio(c(refused & good), c(good)).alias("false_refusal_rate"), ratio(c(~refused & ~good), c(~good)).alias("false_answer_rate"),
    )


def by_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, score, pos, neg: the rows at each distinct score. Everything below works on these counts."""
    return rows.groupBy(*by, "score").agg(F.count_if(F.col("positive")).alias("pos"), F.count_if(~F.col("positive")).alias("neg"))


def auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """The chance that a positive row scores above a negative one, ties counting half; null without both kinds."""
    below = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    counts = by_score(rows, by).withColumn("_under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return counts.groupBy(*by).agg(ratio(F.sum(F.col("pos") * (F.col("_under") + F.col("neg") / 2.0)), F.sum("pos") * F.sum("neg")).alias("auroc"))


def sweep(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, false_refusal_rate, abstention_recall, accuracy: refusing below each distinct score and below +∞."""
    counts = by_score(rows, by)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    end = totals.select(*by, F.lit(float("inf")).alias("score"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    below = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    points = counts.withColumn("score", F.col("score").cast("double")).unionByName(end)
    points = points.withColumns({"_p": F.coalesce(F.sum("pos").over(below), F.lit(0)), "_n": F.coalesce(F.sum("neg").over(below), F.lit(0))}).join(totals, by)
    return points.select(*by, F.col("score").alias("threshold"), ratio(F.col("_p"), F.col("_pos")).alias("false_refusal_rate"), ratio(F.col("_n"), F.col("_neg")).alias("abstention_recall"), ratio(F.col("_pos") - F.col("_p") + F.col("_n"), F.col("_pos") + F.col("_neg")).alias("accuracy"))


def operating_points(points: DataFrame, by: list[str], targets: tuple[float, ...] = (1 / 3, 2 / 3, 1.0)) -> DataFrame:
    """by, target, and of the thresholds that reach this recall the one with the fewest false refusals, then the most
    recall, then the lowest."""
    wanted = points.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).where(F.col("abstention_recall") >= F.col("target") - 1e-9)
    best = wanted.groupBy(*by, "target").agg(F.min(F.struct("false_refusal_rate", (-F.col("abstention_recall")).alias("r"), "threshold")).alias("x"))
    return best.select(*by, "target", "x.threshold", "x.false_refusal_rate", (-F.col("x.r")).alias("abstention_recall"))


def best_threshold(points: DataFrame, by: list[str]) -> DataFrame:
    """The threshold with the highest accuracy, then the fewest false refusals, then the lowest."""
    best = points.groupBy(*by).agg(F.min(F.struct((-F.col("accuracy")).alias("a"), "false_refusal_rate", "threshold", "abstention_recall")).alias("x"))
    return best.select(*by, "x.threshold", "x.false_refusal_rate", "x.abstention_recall", (-F.col("x.a")).alias("accuracy"))
