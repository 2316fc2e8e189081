"""Server-sent events as rows, and windowed request statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_sse(lines: DataFrame) -> DataFrame:
    """stream, event_no, event, data: events of lines (stream, line_no, line). A blank line ends an event; its data lines
    are joined by line feeds, comments skipped; an event without data is none, and without a name a message."""
    before = Window.partitionBy("stream").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("event_no", F.coalesce(F.sum((F.col("line") == "").cast("int")).over(before), F.lit(0))).where("line <> '' AND NOT startswith(line, ':')")
    at = F.instr("line", ":")
    name = F.when(at > 0, F.substring("line", 1, at - 1)).otherwise(F.col("line"))
    value = F.when(at > 0, F.regexp_replace(F.substring("line", at + 1, F.length("line")), "^ ", "")).otherwise("")
    rows = rows.withColumns({"_name": name, "_value": value})
    data = F.array_sort(F.collect_list(F.when(F.col("_name") == "data", F.struct("line_no", "_value"))))
    out = rows.groupBy("stream", "event_no").agg(F.coalesce(F.max_by("_value", F.when(F.col("_name") == "event", F.col("line_no"))), F.lit("message")).alias("event"), data.alias("_data"))
    return out.where(F.size("_data") > 0).select("stream", "event_no", "event", F.array_join(F.transform("_data", lambda x: x["_value"]), "\n").alias("data"))


def event_protocol_problems(events: DataFrame) -> DataFrame:
    """Requests that break sources, deltas, then one answer or error: request_id, problem. events: request_id, seq, kind."""
    last = F.max(F.struct("seq", "kind"))["kind"]
    first = F.min(F.struct("seq", "kind"))["kind"]
    rows = events.groupBy("request_id").agg(first.alias("_f"), last.alias("_l"), F.count_if(F.col("kind").isin("answer", "error")).alias("_ends"))
    problem = F.when(~F.col("_f").isin("sources", "error"), "starts without sources").when(~F.col("_l").isin("answer", "error"), "does not end").when(F.col("_ends") > 1, "ends twice")
    return rows.select("request_id", problem.alias("problem")).where("problem IS NOT NULL")


def windowed_stats(log: DataFrame, window: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """start, requests, errors, mean_ms, p95_ms (approximate) for each window; also on streams, with a watermark."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    return rows.groupBy(F.window(ts, window).alias("_w")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.avg("total_ms").alias("mean_ms"), F.percentile_approx("total_ms", 0.95).alias("p95_ms")).select(F.col("_w.start").alias("start"), "requests", "errors", "mean_ms", "p95_ms")
