"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of white space between words, for Java, RE2 and Python alike.
WS = r"[\x20\x09-\x0D]+"
#: A word character, for rlike.
NON_WS = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def flat_spaces(text: Column) -> Column:
    """Each white-space character becomes one blank; the length in code points is unchanged."""
    return F.regexp_replace(text, r"[\x09-\x0D]", " ")


def words(text: Column) -> Column:
    """Array of the maximal runs without white space; a null text has none."""
    return F.array_remove(F.split(flat_spaces(F.coalesce(text, F.lit(""))), " "), "")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. A temporary one only in local mode, where that
    is unset: there the driver runs all tasks. Elsewhere it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    return f"{root.rstrip('/')}/gleanery-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}.parquet"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gleanery_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes the table of a DataFrame that `written` gave, when nothing will read it any more."""
    spark, path = df.sparkSession, df._gleanery_path.rsplit("/", 1)[0]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def whole_ids(df: DataFrame, column: str) -> None:
    """A TypeError, before any job, for a column that is not of whole numbers."""
    if (kind := df.schema[column].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must be a whole number, not {kind}")


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores behind it as it takes to be no column of df (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key of more than this part of all rows is hot; so there are fewer hot keys than its inverse.
HOT_PART = 1000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], times: str) -> DataFrame:
    """rows with the other columns of table, which has one row for each value of keys (none null) in rows, and in `times`
    how many rows have it. rows and table are written tables.

    Hot keys, fewer than HOT_PART, are looked up in a broadcast table, so that none holds up a task; the others, of at most
    that part of the rows each, are shuffled."""
    total = table.agg(F.sum(times)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(times) * HOT_PART > total))
    cold = rows.join(F.broadcast(table.where(F.col(times) * HOT_PART > total).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).drop(times).unionByName(cold.join(table.where(F.col(times) * HOT_PART <= total), keys).drop(times))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """_own, a struct of all columns of df, and these columns: operators add helpers to it without meeting a caller's names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_own"), *[c.alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame, names: list[str], **results: Column) -> DataFrame:
    """The columns `names` of _own, but for those of results' names, then the results."""
    return df.select(*[F.col("_own")[c].alias(c) for c in names if c not in results], *[c.alias(name) for name, c in results.items()])


_MADE: dict = {}


def once(key: str, make):
    """make() of the first call with this key in this Python worker, so that tasks of one job share tables. Keeps the last
    key's alone: a worker goes on to other operators, and must not add up what they keep."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def small_batches(df: DataFrame) -> DataFrame:
    """df; from here on this session sends 4 MB to Python at a time, unless its own setting differs from Spark's default.
    The default, 64 MB, is held several times over by each task that sends texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":
        conf.set(name, "4m")
    return df


def slices(texts, most_bytes: int = 4 << 20):
    """(first, end) rows of parts of a column of strings, of about most_bytes each: bounds what a worker holds."""
    lo = size = 0
    for k, x in enumerate(texts):
        size += x.as_buffer().size if x.is_valid else 0
        if size >= most_bytes:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
