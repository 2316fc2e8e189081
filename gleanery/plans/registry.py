"""Named queries of the core library and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PARTS = ("search", "logs", "evaluation", "text", "ingest", "corpus")


def _parts():
    return [import_module(f"gleanery.plans.{p}") for p in PARTS]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import hybrid_topk

    return hybrid_topk(spark, sf_dir)


def queries() -> dict:
    return {name: f for part in _parts() for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, sql in part.ORACLES.items()}
