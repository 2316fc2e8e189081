"""Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

_span = [T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]
#: Schemas of the store. Types are fixed here and never inferred.
SCHEMAS: dict[str, T.StructType] = {
    "documents": T.StructType([T.StructField(n, T.StringType()) for n in ("doc_key", "company", "ticker")] + [T.StructField("fiscal_year", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("form", "source_sha256", "parser_version")] + [T.StructField("page_count", T.IntegerType()), T.StructField("canonical_text", T.StringType()), T.StructField("ingested_at", T.TimestampType())]),
    "pages": T.StructType([T.StructField("document_id", T.LongType()), T.StructField("page_number", T.IntegerType()), *_span, T.StructField("width", T.FloatType()), T.StructField("height", T.FloatType()), T.StructField("region", T.StringType())]),
    "blocks": T.StructType([T.StructField("document_id", T.LongType()), T.StructField("block_index", T.IntegerType()), T.StructField("page_number", T.IntegerType()), *_span, T.StructField("kind", T.StringType()), T.StructField("heading_level", T.ShortType()), T.StructField("section", T.ArrayType(T.StringType())), T.StructField("bbox", T.ArrayType(T.FloatType()))]),
    "chunk_sets": T.StructType([T.StructField("id", T.IntegerType()), T.StructField("strategy", T.StringType()), T.StructField("chunk_size", T.IntegerType()), T.StructField("chunk_overlap", T.IntegerType()), T.StructField("tokenizer", T.StringType()), T.StructField("created_at", T.TimestampType())]),
    "chunks": T.StructType([T.StructField("id", T.LongType()), T.StructField("chunk_set_id", T.IntegerType()), T.StructField("document_id", T.LongType()), T.StructField("chunk_index", T.IntegerType()), *_span, T.StructField("page_number", T.IntegerType()), T.StructField("page_end", T.IntegerType()), T.StructField("section", T.ArrayType(T.StringType())), T.StructField("token_count", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("content_sha256", T.StringType()), T.StructField("lexemes", T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))]),
    "embeddings": T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("model", T.StringType()), T.StructField("chunk_set_id", T.IntegerType()), T.StructField("dims", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]),
    "llm_cache": T.StructType([T.StructField(n, T.StringType()) for n in ("key", "provider", "model", "response_text")] + [T.StructField(n, T.IntegerType()) for n in ("input_tokens", "output_tokens")] + [T.StructField("created_at", T.TimestampType()), T.StructField("hits", T.IntegerType()), T.StructField("finish_reason", T.StringType())]),
    "request_log": T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("request_id", T.StringType()), T.StructField("endpoint", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("error", T.StringType()), T.StructField("question_sha256", T.StringType()), T.StructField("question_chars", T.IntegerType()), T.StructField("provider", T.StringType()), T.StructField("model", T.StringType()), T.StructField("input_tokens", T.IntegerType()), T.StructField("output_tokens", T.IntegerType()), T.StructField("cached", T.BooleanType()), T.StructField("refused", T.BooleanType()), T.StructField("truncated", T.BooleanType()), T.StructField("list_usd", T.DoubleType()), T.StructField("billed_usd", T.DoubleType()), T.StructField("total_ms", T.DoubleType()), T.StructField("timings_ms", T.MapType(T.StringType(), T.DoubleType())), T.StructField("counters", T.MapType(T.StringType(), T.LongType()))]),
}
#: What a missing column of a log row is.
LOG_DEFAULTS = {"input_tokens": 0, "output_tokens": 0, "cached": False, "truncated": False, "list_usd": 0.0, "billed_usd": 0.0}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Bulk load. With partitions, only those that rows has are replaced."""
    if partition_by:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def log_row(rows: DataFrame, path: str) -> None:
    """Append to the log; columns that are missing take their defaults."""
    schema = SCHEMAS["request_log"]
    out = rows.select(*[(F.coalesce(F.col(f.name), F.lit(LOG_DEFAULTS[f.name])) if f.name in LOG_DEFAULTS and f.name in rows.columns else F.col(f.name) if f.name in rows.columns else F.lit(LOG_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])
    out.write.mode("append").parquet(path)


def write_once(rows: DataFrame, stem: str, write, tries: int = 100) -> str:
    """Writes to stem, or stem-2, stem-3 and so on if that is taken: earlier results stay. Returns the path."""
    for n in range(1, tries + 1):
        path = stem if n == 1 else f"{stem}-{n}"
        try:
            write(rows.write.mode("errorifexists"), path)
            return path
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
    raise FileExistsError(stem)


def report_columns(frames: list[DataFrame], first: tuple[str, ...] = ("id", "type", "answerable", "question")) -> DataFrame:
    """All rows of results with different columns: the named ones first, the rest sorted."""
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    lead = [c for c in first if c in out.columns]
    return out.select(*lead, *sorted(c for c in out.columns if c not in lead))


def plan_bytes(rows: DataFrame) -> int:
    """The optimiser's estimate of the size."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def markdown(rows: DataFrame, digits: int = 3, most: int = 500) -> str:
    """A small report as a Markdown table; an error for more than `most` rows."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [rows.columns, ["---"] * len(rows.columns), *[[show(v) for v in r] for r in found]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines) + "\n"


def schema_versions(applied: DataFrame, known: list[str]) -> list[str]:
    """The versions to apply yet, in sequence. applied: version. A version between applied ones is an error."""
    have = {r[0] for r in applied.select("version").distinct().collect()}
    left = [v for v in known if v not in have]
    if left and have and min(left) < max(have):
        raise ValueError(f"{min(left)} comes before versions that are applied")
    return left


def with_provenance(rows: DataFrame, label_sha: str, commit: str, dirty: bool, config: dict, wall_seconds: float) -> DataFrame:
    """rows with what a run needs to be repeated, in every row."""
    pairs = [x for k, v in sorted(config.items()) for x in (F.lit(k), F.lit(str(v)))]
    return rows.withColumns({"label_sha": F.lit(label_sha), "commit": F.lit(commit), "dirty": F.lit(dirty), "config": F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"), "wall_seconds": F.lit(float(wall_seconds))})
