"""Connected components: labels spread to neighbours and jump along themselves until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node of its component): one row for each node of an edge to another.

    Edges with a null end and loops are passed over; edges may be repeated and come in either direction; no edges give no
    rows. Each round gives a node the smallest label among itself and its neighbours, then that label's own label. A hub's
    edges are combined before each shuffle by key, and rounds are written, so nothing is gathered in one place; a round's
    tables go when the next one is written."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL AND node <> other")
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component"), F.lit(True).alias("changed")), "labels")
    while not labels.where("changed").isEmpty():
        last, spread = labels, both.join(labels.select(F.col("node").alias("other"), "component"), "other").select("node", "component")
        least = spread.groupBy("node").agg(F.min("component").alias("least"))
        near = written(labels.select("node", F.col("component").alias("was")).join(least, "node").select("node", "was", F.least("was", "least").alias("component")), "near")
        jump = near.select(F.col("node").alias("component"), F.col("component").alias("far"))
        labels = written(near.join(jump, "component", "left").select("node", F.least("component", "far").alias("component"), (F.least("component", "far") != F.col("was")).alias("changed")), "labels")
        dropped(last)
        dropped(near)
    dropped(both)
    return labels.select("node", "component")
