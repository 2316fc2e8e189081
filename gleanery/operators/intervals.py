"""Joins on ranges. Each has an equality key, so that it runs as a hash or merge join with a residual condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, key: str, *, l=("l_start", "l_end"), r=("r_start", "r_end"), how: str = "inner") -> DataFrame:  # noqa: E741
    """Pairs of one key whose half-open ranges overlap."""
    return left.join(right, (left[key] == right[key]) & (right[r[0]] < left[l[1]]) & (right[r[1]] > left[l[0]]), how).drop(right[key])


def containing(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, id: str) -> DataFrame:
    """points with the first range (least start, then id) that holds them, null if none does."""
    pairs = points.join(ranges.select(F.col(key).alias("_key"), start, end, id), (points[key] == F.col("_key")) & (F.col(start) <= points[at]) & (points[at] < F.col(end)))
    best = pairs.groupBy(key, at).agg(F.min(F.struct(start, id)).alias("_best")).select(key, at, F.col(f"_best.{id}").alias(id))
    return points.join(best, [key, at], "left")


def as_of(points: DataFrame, marks: DataFrame, key: str, at: str, start: str, values: list[str], *, floor: bool = False) -> DataFrame:
    """points with the values of the last mark at or before them. floor: points before all marks get the first one.

    One sort of both sides together, no pairs: marks carry their values forward along each key. Only marks of keys that
    points have take part."""
    marks = marks.join(points.select(key).distinct(), key, "left_semi")
    p = points.withColumns({"_at": F.col(at), "_kind": F.lit(1), "_mark": F.lit(None)}).select(key, "_at", "_kind", F.struct(*points.columns).alias("_point"), F.lit(None).cast(marks.select(F.struct(start, *values)).schema[0].dataType).alias("_mark"))
    m = marks.select(key, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(p.schema["_point"].dataType).alias("_point"), F.struct(start, *values).alias("_mark"))
    order = Window.partitionBy(key).orderBy("_at", "_kind")
    rows = p.unionByName(m).withColumn("_last", F.last("_mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if floor:
        rows = rows.withColumn("_last", F.coalesce("_last", F.first("_mark", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))))
    return rows.where("_point IS NOT NULL").select("_point.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def centre_inside(blocks: DataFrame, boxes: DataFrame, key: str, pad: float = 2.0) -> DataFrame:
    """blocks (x0, y0, x1, y1) whose centre lies in no box (bx0, by0, bx1, by1) of the same key, `pad` added on each side."""
    x, y = (blocks["x0"] + blocks["x1"]) / 2, (blocks["y0"] + blocks["y1"]) / 2
    inside = (blocks[key] == boxes[key]) & (x >= boxes["bx0"] - pad) & (x <= boxes["bx1"] + pad) & (y >= boxes["by0"] - pad) & (y <= boxes["by1"] + pad)
    return blocks.join(boxes, inside, "left_anti")


def pages_hit(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """hits (qid, doc, page, page_end) of which some page is in the question's evidence (qid, doc, ev_page)."""
    ev = evidence.select(F.col("qid").alias("_q"), F.col("doc").alias("_d"), "ev_page")
    return hits.join(ev, (hits["qid"] == F.col("_q")) & (hits["doc"] == F.col("_d")) & F.col("ev_page").between(hits["page"], hits["page_end"]), "left_semi")
