"""Tables that are made once and read by many queries, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only in local mode, where that may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    return f"{root.rstrip('/')}/gleanery-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    path = shared_dir(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_once(spark: SparkSession, key: tuple, make) -> str:
    """The folder that make(folder) filled when this session first asked for key; asked again, it fills nothing."""
    own = (spark.sparkContext.applicationId, *key)
    if own not in _MADE:
        folder = shared_dir(spark)
        make(folder)
        _MADE[own] = folder
    return _MADE[own]
