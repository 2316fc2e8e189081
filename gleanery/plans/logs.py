"""Registered queries on the request log, which the events table stands for, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, store
from ..operators import request_log as rl
from ..sources.tables import table
from ..streaming.events import windowed_stats

AS_OF = "2024-01-30 00:00:00"
HOURS = 240.0


def request_log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    bad = F.col("event_type") == "error"
    log = e.select(
        F.col("event_id").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/"), F.col("event_type")).alias("endpoint"), F.when(bad, 500).otherwise(200).alias("status"),
        F.when(bad, F.concat(F.lit("code_"), (F.col("user_id") % 7).cast("string"))).alias("error"), (F.col("event_type") == "view").alias("cached"), F.when(~bad, F.col("event_type") == "signup").alias("refused"), (k % 10 == 0).alias("truncated"),
        k.alias("input_tokens"), (k % 13).alias("output_tokens"), F.col("value").alias("total_ms"), F.col("props"), F.col("user_id"), F.lit(None).cast("int").alias("_"),
    ).drop("_")
    return rl.with_costs(log, 0.8, 4.0, free_tier=True)


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 4) for c in columns})


def request_stats(spark, d):
    return _rounded(rl.volumes(request_log(spark, d)), "list_usd", "billed_usd", "p50_ms", "p95_ms")


def stats_by_endpoint(spark, d):
    return _rounded(rl.volumes(request_log(spark, d), ["endpoint"]), "list_usd", "billed_usd", "p50_ms", "p95_ms")


def trailing_window(spark, d):
    log = request_log(spark, d).where(filters.trailing_window("ts", AS_OF, HOURS))
    return _rounded(rl.volumes(log), "list_usd", "billed_usd", "p50_ms", "p95_ms")


def errors_by_code(spark, d):
    return rl.counts_by(request_log(spark, d), "error")


def requests_by_endpoint(spark, d):
    return rl.counts_by(request_log(spark, d), "endpoint")


def stage_percentiles(spark, d):
    return _rounded(rl.stage_percentiles(rl.timings_from_json(request_log(spark, d), "props")), "p50_ms", "p95_ms")


def requests_with_stage(spark, d):
    return request_log(spark, d).where(filters.has_key(F.col("props"), "k")).groupBy("endpoint").agg(F.count("*").alias("n"))


def stage_medians(spark, d):
    """Median of the stage timings over the requests that failed."""
    log = rl.timings_from_json(request_log(spark, d), "props")
    return _rounded(rl.stage_medians(log, log.where("status >= 400")), "median_ms")


def stage_maps(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return rl.stage_map(e).select("request_id", F.round(F.try_element_at("timings_ms", F.lit("click")), 2).alias("click_ms"), F.size("timings_ms").alias("stages"))


def error_taxonomy(spark, d):
    kinds = F.element_at(F.array(*[F.lit(x[0]) for x in rl.ERRORS]), (F.col("user_id") % len(rl.ERRORS) + 1).cast("int"))
    rows = table(spark, d, "events").select(F.when(F.col("event_type") == "error", kinds).alias("failure"))
    return rl.classified(rows).groupBy("status", "error").agg(F.count("*").alias("n"))


def request_records(spark, d):
    """Questions as hashes and lengths: user turns of the conversations."""
    turns = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("request_id"), F.col("turn"), F.col("text").alias("question"), F.create_map(F.lit("pack"), F.lit(1.005)).alias("timings_ms"))
    return rl.request_record(turns).drop("timings_ms")


def daily_stats(spark, d):
    rows = windowed_stats(request_log(spark, d))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "requests", "errors", F.round("mean_ms", 4).alias("mean_ms"))


def log_violations(spark, d):
    log = request_log(spark, d)
    return store.violations(log, unique=[["request_id"]], checks={"status": F.col("status").isin(200, 500), "positive": F.col("total_ms") >= 10})


_LOG = """WITH e AS (SELECT *, (props->>'$.k')::INT AS k FROM events),
log AS (SELECT event_id, ts, user_id, k, '/' || event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
CASE WHEN event_type = 'error' THEN 'code_' || (user_id % 7) END AS error, event_type = 'view' AS cached, CASE WHEN event_type <> 'error' THEN event_type = 'signup' END AS refused, k % 10 = 0 AS truncated,
k AS input_tokens, k % 13 AS output_tokens, value AS total_ms, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE round_even((k * 0.8::DOUBLE + (k % 13) * 4.0::DOUBLE) / 1000000, 8) END AS list_usd FROM e)
"""
_VOLUMES = """count(*) AS requests, count(*) FILTER (status >= 400) AS errors, count(*) FILTER (cached) AS cache_hits, count(*) FILTER (refused) AS refusals, count(*) FILTER (truncated) AS truncated,
coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, round(coalesce(sum(list_usd), 0), 4) AS list_usd, 0.0::DOUBLE AS billed_usd,
round_even(count(*) FILTER (cached) / count(*), 4) AS cache_hit_rate, round_even(count(*) FILTER (refused) / count(*), 4) AS refusal_rate, round_even(sum(list_usd) * 1000 / count(*), 4) AS list_usd_per_1k,
round(quantile_cont(total_ms, 0.5), 4) AS p50_ms, round(quantile_cont(total_ms, 0.95), 4) AS p95_ms"""
QUERIES = {f.__name__: f for f in (request_stats, stats_by_endpoint, trailing_window, errors_by_code, requests_by_endpoint, stage_percentiles, requests_with_stage, stage_medians, stage_maps, error_taxonomy, request_records, daily_stats, log_violations)}
_TAXONOMY = ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in rl.ERRORS)
ORACLES = {
    "request_stats": f"{_LOG} SELECT {_VOLUMES} FROM log",
    "stats_by_endpoint": f"{_LOG} SELECT endpoint, {_VOLUMES} FROM log GROUP BY ALL",
    "trailing_window": f"{_LOG} SELECT {_VOLUMES} FROM log WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL {int(HOURS)} HOUR",
    "errors_by_code": f"{_LOG} SELECT error, count(*) AS n FROM log WHERE error IS NOT NULL GROUP BY ALL",
    "requests_by_endpoint": f"{_LOG} SELECT endpoint, count(*) AS n FROM log GROUP BY ALL",
    "stage_percentiles": f"{_LOG} SELECT 'k' AS stage, count(*) AS n, round(quantile_cont(k::DOUBLE, 0.5), 4) AS p50_ms, round(quantile_cont(k::DOUBLE, 0.95), 4) AS p95_ms FROM log WHERE k IS NOT NULL HAVING count(*) > 0",
    "requests_with_stage": f"{_LOG} SELECT endpoint, count(*) AS n FROM log WHERE k IS NOT NULL GROUP BY ALL",
    "stage_medians": f"{_LOG} SELECT 'k' AS stage, round(median(k::DOUBLE), 4) AS median_ms FROM log WHERE status >= 400 AND k IS NOT NULL HAVING count(*) > 0",
    "stage_maps": "SELECT user_id AS request_id, round(sum(value) FILTER (event_type = 'click'), 2) AS click_ms, count(DISTINCT event_type)::INT AS stages FROM events GROUP BY ALL",
    "error_taxonomy": f"WITH t AS (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {_TAXONOMY}) AS v(failure, status, error)) SELECT coalesce(t.status, 200)::INT AS status, t.error AS error, count(*) AS n FROM events LEFT JOIN t ON event_type = 'error' AND user_id % {len(rl.ERRORS)} = t.i GROUP BY ALL",
    "request_records": "SELECT conv_id AS request_id, turn, sha256(text) AS question_sha256, length(text)::INT AS question_chars FROM conversations WHERE role = 'user'",
    "daily_stats": f"{_LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, round(avg(total_ms), 4) AS mean_ms FROM log GROUP BY ALL",
    "log_violations": f"{_LOG} SELECT 'check positive' AS rule, count(*) AS n FROM log WHERE total_ms < 10 HAVING count(*) > 0",
}
