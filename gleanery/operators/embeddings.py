"""Embeddings by content: reuse, what is missing, one vector for each distinct text."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def hashed_vector(text: str, dims: int) -> list[float]:
    """A unit vector that depends on nothing but the text: chained SHA-256 digests as numbers about 0."""
    data, block = b"", text.encode()
    while len(data) < 4 * dims:
        block = hashlib.sha256(block).digest()
        data += block
    raw = np.frombuffer(data[: 4 * dims], "<u4").astype(np.float64) / 2**31 - 1
    return (raw / max(np.linalg.norm(raw), 1e-12)).astype(np.float32).tolist()


def embed(rows: DataFrame, text: str = "text", dims: int = 64, encode=hashed_vector, into: str = "embedding") -> DataFrame:
    """rows with a vector for each distinct text, made once."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else encode(x, dims))

    once = rows.select(F.sha2(text, 256).alias("_sha"), F.col(text).alias("_text")).dropDuplicates(["_sha"]).withColumn(into, vectors("_text")).select("_sha", into)
    return rows.withColumn("_sha", F.sha2(text, 256)).join(once, "_sha", "left").drop("_sha")


def embed_queries(questions: DataFrame, dims: int = 64, encode=hashed_vector, prefix: str = QUERY_PREFIX) -> DataFrame:
    return embed(questions.withColumn("_q", F.concat(F.lit(prefix), "question")), "_q", dims, encode, "qvec").drop("_q")


def model_key(name: Column, revision: Column) -> Column:
    return F.concat(name, F.lit("@"), F.left(revision, F.lit(8)))


def missing(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks (chunk_id) without a vector."""
    return chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")


def reuse(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """chunk_id, donor_id, embedding: for chunks without a vector, that of the chunk with the same content and the
    smallest id that has one. Donors are one row for each content before they meet the chunks."""
    donors = chunks.join(embeddings, "chunk_id").groupBy("content_sha256").agg(F.min(F.struct(F.col("chunk_id").alias("donor_id"), "embedding")).alias("_d"))
    rows = missing(chunks, embeddings).join(donors, "content_sha256")
    return rows.select("chunk_id", "_d.donor_id", "_d.embedding")


def to_embed(chunks: DataFrame, embeddings: DataFrame, text: str = "text") -> DataFrame:
    """content_sha256, text, chunk_ids: distinct contents that no vector exists for."""
    have = chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_semi").select("content_sha256").distinct()
    rest = chunks.join(have, "content_sha256", "left_anti")
    return rest.groupBy("content_sha256").agg(F.min(text).alias(text), F.count("*").alias("chunks"), F.min("chunk_id").alias("first_chunk"))
