"""The document store: what an ingest changes, keys, cascades, catalogs, constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_actions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """doc_key, action: inserted, replaced or unchanged (same hash and parser version). Edits of other columns alone
    count as unchanged."""
    s = stored.select("doc_key", F.col("source_sha256").alias("_sha"), F.col("parser_version").alias("_v"), F.lit(True).alias("_there"))
    rows = incoming.join(s, "doc_key", "left")
    same = F.col("source_sha256").eqNullSafe(F.col("_sha")) & F.col("parser_version").eqNullSafe(F.col("_v"))
    return rows.select("doc_key", F.when(F.col("_there").isNull(), "inserted").when(same, "unchanged").otherwise("replaced").alias("action"))


def upserted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after the ingest: new and replaced rows in, their old versions out."""
    changed = upsert_actions(stored, incoming).where("action <> 'unchanged'").select("doc_key")
    return stored.join(changed, "doc_key", "left_anti").unionByName(incoming.join(changed, "doc_key", "left_semi").select(*stored.columns))


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def get_or_create(stored: DataFrame, wanted: DataFrame, keys: list[str], id: str = "id") -> DataFrame:
    """keys, id: the stored id, or the next free ones in the order of the keys. A rerun burns none.

    Dimension tables only: the ids of what is new are counted in one window."""
    top = stored.agg(F.coalesce(F.max(id), F.lit(0))).first()[0]
    new = wanted.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")
    made = new.withColumn(id, (F.row_number().over(Window.orderBy(*keys)) + top).cast(stored.schema[id].dataType))
    return stored.select(*keys, id).join(wanted.select(*keys).distinct(), keys, "left_semi").unionByName(made)


def to_parse(manifest: DataFrame, parsed: DataFrame, version: str) -> DataFrame:
    """Manifest rows without a parsed version of the same file by the same parser."""
    done = parsed.where(F.col("parser_version") == version).select("doc_key", F.col("source_sha256").alias("sha256"))
    return manifest.join(done, ["doc_key", "sha256"], "left_anti")


def catalog(documents: DataFrame, children: DataFrame, key: str, keep: Column) -> DataFrame:
    """key, n: all documents, with the number of their children that pass `keep`, 0 too."""
    counts = children.where(keep).groupBy(key).agg(F.count("*").alias("n"))
    return documents.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def inspection(pages: DataFrame, by: str = "doc", text: str = "text") -> DataFrame:
    """by, pages, chars, and the fewest, median and most characters on a page."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return pages.groupBy(by).agg(F.count("*").alias("pages"), F.sum(n).alias("chars"), F.min(n).alias("least"), F.median(n).alias("median"), F.max(n).alias("most"))


def violations(rows: DataFrame, *, unique: list[list[str]] = (), checks: dict[str, Column] | None = None, parents: dict[str, tuple[DataFrame, list[str]]] | None = None) -> DataFrame:
    """rule, n: broken keys, checks (a null is no break) and references. No row for a rule that holds."""
    found = []
    for keys in unique:
        found.append(rows.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"unique {', '.join(keys)}").alias("rule"), "n"))
    if checks:
        counts = rows.agg(*[F.count_if(~c).alias(name) for name, c in checks.items()])
        found.append(counts.select(F.explode(F.array(*[F.struct(F.lit(f"check {n}").alias("rule"), F.col(f"`{n}`").alias("n")) for n in checks])).alias("x")).select("x.*"))
    for name, (parent, keys) in (parents or {}).items():
        found.append(rows.join(parent.select(*keys), keys, "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"reference {name}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, found).where("n > 0")


def document_checks() -> dict[str, Column]:
    return {"page_count above 0": F.col("page_count") > 0, "sha of 64": F.length("source_sha256") == 64}


def chunk_checks() -> dict[str, Column]:
    return {"start before end": F.col("char_start") < F.col("char_end"), "pages in order": F.col("page_number") <= F.col("page_end"), "1 to 510 tokens": F.col("token_count").between(1, 510)}


def chunk_set_checks() -> dict[str, Column]:
    return {"strategy": F.col("strategy").isin("fixed", "recursive", "structure"), "overlap below size": (F.col("chunk_overlap") >= 0) & (F.col("chunk_overlap") < F.col("chunk_size"))}


def block_checks() -> dict[str, Column]:
    return {"start before end": F.col("char_start") < F.col("char_end"), "kind": F.col("kind").isin("text", "heading", "table"), "box of 4": F.col("bbox").isNull() | (F.size("bbox") == 4)}
