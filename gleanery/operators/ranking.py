"""Ranks, top-k for each question, presentation order, winners."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared to this many digits, so that ranks don't hang on the order in which floats were summed.
SCORE_DIGITS = 9


def ranked(rows: DataFrame, by: list[str], order: list[Column], into: str = "rank") -> DataFrame:
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(rows: DataFrame, k: int, *, by: str = "qid", score: str = "score", tie: str = "id", ascending: bool = False, into: str = "rank") -> DataFrame:
    """The k best rows of each question, 1 the best; ties by the smaller `tie`. Spark cuts each partition's rows first."""
    key = F.round(F.col(score), SCORE_DIGITS)
    return ranked(rows, [by], [key.asc() if ascending else key.desc(), F.col(tie).asc()], into).where(F.col(into) <= k)


def best_rows(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, sign: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query of a task, ties by id. sign: 1 if the least score is best, else -1."""
    order = np.lexsort((ids, sign * np.round(scores, SCORE_DIGITS), query))
    query, ids, scores = query[order], ids[order], scores[order]
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if query.size else np.empty(0, np.int64)
    place = np.arange(query.size) - np.repeat(starts, np.diff(np.append(starts, query.size)))
    keep = place < k
    return query[keep], ids[keep], scores[keep]


def presentation_position(rank0: Column, n: Column, order: str) -> Column:
    """0-based place in the prompt of the 0-based rank. sandwich: the best at both ends, the weakest in the middle."""
    if order == "rank":
        return rank0
    if order != "sandwich":
        raise ValueError("order is rank or sandwich")
    return F.when(rank0 % 2 == 0, F.floor(rank0 / 2)).otherwise(n - 1 - F.floor(rank0 / 2)).cast("int")


def winners(rows: DataFrame, name: str, metrics: dict[str, bool]) -> DataFrame:
    """metric, place (1 or 2), config, value: the best two configurations of each metric. metrics: True if more is
    better. Ties by name; configurations without a value don't take part."""
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    long = rows.select(F.col(name).alias("config"), F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)")).where("value IS NOT NULL")
    less = [m for m, more in metrics.items() if not more]
    key = F.when(F.col("metric").isin(less), F.col("value")).otherwise(-F.col("value")) if less else -F.col("value")
    return ranked(long, ["metric"], [key.asc(), F.col("config").asc()], "place").where("place <= 2").select("metric", "place", "config", "value")


def result_page(rows: DataFrame, n: int, offset: int, *order: Column) -> DataFrame:
    """n rows from the given place on, in a total order."""
    return rows.orderBy(*order).offset(offset).limit(n)
