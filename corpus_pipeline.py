"""The corpus pipeline: documents to the token ids of a cleaned, deduplicated, mixed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece_codec
from gleanery.llm.common import documents, fresh, written

#: Below this share of its letters, no language is the document's. Texts of two or three languages stay.
LEAST_SHARE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts too), and those of which no language has a quarter of the
    letters. Without any labelled text nothing is learnt, and all go; an empty table stays empty."""
    model = language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    moved = {c: fresh(docs, f"own_{c}") for c in docs.columns if c in ("lang_pred", "score")}
    found = language_id.identify(docs.withColumnsRenamed(moved), model, spans=False)
    found = found.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SHARE))
    return found.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays, once. Null texts count as empty; null doc_ids come first, and
    a row repeated with its doc_id and text counts once. Takes empty tables and columns of any names."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id, and with it all rows of that doc_id;
    rows without doc_id or words stay. Near means 80 % of five-word shingles. Takes empty tables and
    columns of any names."""
    stays = fresh(docs, "_stays")
    stay = near_dedup.near_groups(docs).where("kept").select(F.col("doc_id").alias(stays)).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay[stays]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix's blocks, up to three times each: a source's words come to its target but for half a block.
    Documents are whole but for two of each source, of which a part is taken. Rows without words go; null sources are one
    source. Takes empty tables and columns of any names."""
    return mixing.mixed_texts(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids, without their texts; a null text has none. Columns named as the results are replaced."""
    return sentencepiece_codec.encode_documents(docs).drop("text")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Language models, minima and piece splits are beyond SQL. tests/llm holds run() against a plain Python version: language
#: scores by a plain path search over the same word scores, exact groups by their texts, near copies by all pairs, the mix
#: by a plain walk over the sources' words, piece ids by decoding them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = written(docs, f"stage_{n}")
    return docs
