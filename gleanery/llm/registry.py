"""The subpackage's queries, opN_<name>, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, mixing, near_dedup, quality, sentencepiece_codec, sharding, substring_dedup, token_counts, warc
from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document's whole text; a null text counts as empty and is not kept."""
    return quality.quality_rows(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of its equal texts that stays. Null texts are empty; repeated rows count each; null doc_ids come last."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard of 40 and slot in it, by law `rows`. Null texts have no bytes; null doc_ids are placed by their texts."""
    return sharding.shard_documents(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 50-word windows that a smaller doc_id has. Null texts have no words; null doc_ids come last."""
    return substring_dedup.repeats_removed(documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as read back from the archives just written. Null payloads are empty; equal ones refer to the largest page_id."""
    return warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its component at 80 % of two-word shingles. Rows of one doc_id are one document; those without words are linked with nothing."""
    return near_dedup.near_groups(documents(spark, sf_dir), near_dedup.CONTRACT_SHINGLE)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's piece ids and of the text decoded from them. A null text has no pieces."""
    return sentencepiece_codec.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), digests=True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of each document. Null and empty texts have none."""
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learnt from the labelled documents that are not held out. Null texts and those without letters are `und`."""
    return language_id.predict(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes. Null texts have no words; a null source is the last source."""
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_exact_dedup, op3_sharding, op4_substring_dedup, op5_warc, op6_minhash_dedup, op7_sentencepiece, op8_token_counts, op9_language_id, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE_SQL, "op2_exact_dedup": exact_dedup.ORACLE_SQL, "op4_substring_dedup": substring_dedup.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL, "op6_minhash_dedup": near_dedup.ORACLE_SQL}
