"""Exact dedup by block naming.

A normalised text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name (their place in the
sorted list of distinct blocks), then adjacent pairs of names are sorted and named in turn, until each document is one
name. Two texts of as many blocks have one name exactly if they are equal.

The texts are read, normalised and cut once, into a written table of blocks. Block contents cross the network once, combined
before the shuffle, to prove that no two different blocks share the 64-bit tag by which all later steps know them; where
two do, their contents tell them apart. Later steps move integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, dropped, fresh, spread_join, written

BLOCK_BYTES = 4096


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """row, n_blocks, idx, tag, block, and in the first block's row doc_id and sha: a row for each block; an empty text is
    one empty block. docs: row, doc_id, text."""
    texts = docs.select("row", "doc_id", normalised(F.col("text")).alias("_text"))
    texts = texts.select("row", "doc_id", F.sha2("_text", 256).alias("sha"), F.col("_text").cast("binary").alias("_bytes"), F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / block_bytes)).cast("int").alias("n_blocks"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("_bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = texts.select("row", "doc_id", "sha", "n_blocks", F.posexplode(cut).alias("idx", "block"))
    in_first = {c: F.when(F.col("idx") == 0, F.col(c)) for c in ("doc_id", "sha")}
    return rows.withColumns(in_first | {"tag": F.xxhash64("block")})


def _named(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """rows, a written table, with `name` for their distinct keys: an integer that follows the keys' sort order."""
    names = rows.groupBy(*keys).agg(F.count("*").alias("times")).orderBy(*keys).withColumn("name", F.monotonically_increasing_id())
    return spread_join(rows, written(names, tag), keys, "times").drop(*keys)


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row, doc_id, sha, n_blocks, name: one row for each row of docs (row: unique, doc_id, text).

    Texts are equal exactly if n_blocks and name are. A null text counts as empty."""
    blocks = written(_blocks(docs, block_bytes), "blocks")
    shared = written(blocks.select("tag", "block").distinct().groupBy("tag").agg(F.count("*").alias("n")).where("n > 1").select("tag"), "shared_tags")
    rows = blocks.drop("block").withColumn("nth", F.lit(0))
    if not shared.isEmpty():
        twins = blocks.join(shared, "tag", "left_semi").select("tag", "block").distinct()
        twins = written(twins.withColumn("nth", F.row_number().over(Window.partitionBy("tag").orderBy("block"))), "twins")
        rows = written(blocks.join(twins, ["tag", "block"], "left").withColumn("nth", F.coalesce("nth", F.lit(0))).drop("block"), "tagged")
    rows = written(_named(rows, ["tag", "nth"], "names_0"), "level_0")
    dropped(blocks)
    left, level, done = rows.agg(F.max("n_blocks")).first()[0] or 1, 0, []
    while True:
        done.append(rows.where(F.ceil(F.col("n_blocks") / F.lit(1 << level)) == 1).select("row", "doc_id", "sha", "n_blocks", "name"))
        if left == 1:
            break
        level, left = level + 1, (left + 1) // 2
        longer = rows.where(F.ceil(F.col("n_blocks") / F.lit(1 << (level - 1))) > 1)
        of = lambda odd: F.coalesce(F.max(F.when(F.col("idx") % 2 == odd, F.col("name"))), F.lit(-1).cast("long"))
        pairs = longer.groupBy("row", "n_blocks", F.shiftright("idx", 1).alias("idx")).agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), of(0).alias("left"), of(1).alias("right"))
        rows = written(_named(written(pairs, f"pairs_{level}"), ["left", "right"], f"names_{level}"), f"level_{level}")
    named = done[0]
    for x in done[1:]:
        named = named.unionByName(x)
    return named


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Of equal texts the row with the smallest doc_id stays; where several rows have that, one of them. A row repeated with
    its doc_id and text counts each time. A null text counts as empty; a null doc_id comes after all others, so keep_id is
    null where a text has no other. An empty table gives none. Other columns are not read."""
    named = name_documents(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), block_bytes)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = written(named.groupBy("n_blocks", "name").agg(first.alias("first"), F.count("*").alias("times")), "groups")
    rows = spread_join(named, groups.withColumn("group_size", F.col("times")), ["n_blocks", "name"], "times")
    kept = F.col("row") == F.col("first.row")
    return rows.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def distinct_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns, whatever these are called. Of rows that are alike
    in doc_id and normalised text, any one stays."""
    groups = written(exact_groups(docs, block_bytes).select("doc_id", "text_sha256", "kept"), "exact_groups")
    sha, id_ = fresh(docs, "_sha"), fresh(docs, "_id")
    named = lambda df: df.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha + "_"))
    rows = docs.withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    same = lambda other: rows["doc_id"].eqNullSafe(other[id_]) & (rows[sha] == other[sha + "_"])
    stays = named(groups.where("kept"))
    kept = rows.join(stays, same(stays), "left_semi")
    alike = written(named(groups.groupBy("doc_id", "text_sha256").count().where("count > 1")), "alike")
    if not alike.isEmpty():
        rows = kept
        kept = rows.join(alike, same(alike), "left_anti").unionByName(rows.join(alike, same(alike), "left_semi").dropDuplicates(["doc_id", sha]))
    return kept.drop(sha)


ORACLE_SQL = r"""
WITH flat AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM flat
"""
