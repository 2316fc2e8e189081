"""Analytics of a request log: volumes, rates, percentiles of total and stage latency, errors, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cost, percentile_cont, ratio

# What a kind of failure is reported as.
ERRORS = [
    ("missing_key", 503, "llm_not_configured"), ("authentication", 502, "llm_auth_failed"), ("quota", 503, "llm_quota_exhausted"),
    ("rate_limit", 503, "llm_rate_limited"), ("timeout", 504, "llm_timeout"), ("connection", 502, "llm_unavailable"),
    ("database", 503, "database_unavailable"), ("other", 500, "internal_error"),
]


def volumes(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, sums (0 if empty) and rates, whose denominator is all rows; null without any. One pass."""
    n = F.count("*")
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return log.groupBy(*(by or [])).agg(
        n.alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.count_if("cached").alias("cache_hits"), F.count_if("refused").alias("refusals"), F.count_if("truncated").alias("truncated"),
        sums("input_tokens").alias("input_tokens"), sums("output_tokens").alias("output_tokens"), sums("list_usd").alias("list_usd"), sums("billed_usd").alias("billed_usd"),
        F.bround(ratio(F.count_if("cached"), n), 4).alias("cache_hit_rate"), F.bround(ratio(F.count_if("refused"), n), 4).alias("refusal_rate"), F.bround(ratio(sums("list_usd") * 1000, n), 4).alias("list_usd_per_1k"),
        percentile_cont("total_ms", 0.5).alias("p50_ms"), percentile_cont("total_ms", 0.95).alias("p95_ms"),
    )


def counts_by(log: DataFrame, column: str) -> DataFrame:
    return log.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def stage_percentiles(log: DataFrame, timings: str = "timings_ms") -> DataFrame:
    """stage, n, p50_ms, p95_ms: all stages of the timing maps in one pass."""
    return log.select(F.explode(timings).alias("stage", "ms")).where("ms IS NOT NULL").groupBy("stage").agg(F.count("*").alias("n"), percentile_cont("ms", 0.5).alias("p50_ms"), percentile_cont("ms", 0.95).alias("p95_ms"))


def timings_from_json(log: DataFrame, column: str) -> DataFrame:
    return log.withColumn("timings_ms", F.from_json(column, "map<string,double>"))


def stage_map(spans: DataFrame) -> DataFrame:
    """request_id, timings_ms: repeated stages summed, 2 digits."""
    sums = spans.groupBy("request_id", "stage").agg(F.bround(F.sum("ms"), 2).alias("ms"))
    return sums.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("timings_ms"))


def stage_medians(log: DataFrame, requests: DataFrame, timings: str = "timings_ms") -> DataFrame:
    """stage, median_ms over the rows of log whose request_id is in requests: request_id."""
    return log.join(requests.select("request_id"), "request_id", "left_semi").select(F.explode(timings).alias("stage", "ms")).groupBy("stage").agg(F.median("ms").alias("median_ms"))


def request_record(requests: DataFrame) -> DataFrame:
    """The question as a hash and a length only; timings to 2 digits."""
    return requests.withColumns({"question_sha256": F.sha2("question", 256), "question_chars": F.length("question"), "timings_ms": F.transform_values("timings_ms", lambda k, v: F.bround(v, 2))}).drop("question")


def with_costs(requests: DataFrame, price_in: float, price_out: float, free_tier: bool = False) -> DataFrame:
    """list_usd and billed_usd: 0 if cached, the latter 0 on a free tier as well."""
    own = F.when(F.col("cached"), 0.0).otherwise(cost(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out))
    return requests.withColumns({"list_usd": own, "billed_usd": F.lit(0.0) if free_tier else own})


def error_table(spark) -> DataFrame:
    return spark.createDataFrame(ERRORS, "failure string, status int, error string")


def classified(rows: DataFrame, column: str = "failure") -> DataFrame:
    """rows with status and error of their failure; unknown failures are internal errors."""
    table = error_table(rows.sparkSession).withColumnRenamed("failure", column)
    out = rows.join(F.broadcast(table), column, "left")
    bad = F.col(column).isNotNull()
    return out.withColumns({"status": F.when(bad, F.coalesce("status", F.lit(500))).otherwise(200), "error": F.when(bad, F.coalesce("error", F.lit("internal_error")))})


def log_lines(rows: DataFrame) -> DataFrame:
    """value: one JSON object for each row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
