"""Manifests, labelled questions, run results and web pages as sources."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MANIFEST = "documents array<struct<doc_key:string,company:string,ticker:string,gics_sector:string,fiscal_year:int,form:string,path:string,source_url:string,original_url:string,sha256:string,bytes:bigint>>"
GOLDEN = "id string, type string, question string, answer string, evidence array<array<struct<doc:string,quote:string>>>, note string"
EXTERNAL = "financebench_id string, question string, doc_name string, evidence array<struct<doc_name:string,evidence_page_num:int>>"
STAMPED = r"(\d{8}T\d{6}Z)_(.+)\.json$"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.inline("documents"))


def checked_files(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """expected (path, sha256) with found_sha256 and ok, by the bytes of the files."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.sha2("content", 256).alias("found_sha256"))
    rows = expected.withColumn("_name", F.element_at(F.split("path", "/"), -1)).join(files, "_name", "left").drop("_name")
    return rows.withColumn("ok", F.coalesce(F.col("found_sha256") == F.col("sha256"), F.lit(False)))


def golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path)


def golden_quotes(questions: DataFrame) -> DataFrame:
    """qid, item, alternative, doc, quote: one row for each quote."""
    items = questions.select(F.col("id").alias("qid"), F.posexplode("evidence").alias("item", "_alternatives"))
    return items.select("qid", "item", F.posexplode("_alternatives").alias("alternative", "_q")).select("qid", "item", "alternative", "_q.doc", "_q.quote")


def external(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Questions on known documents (doc_key); evidence pages from 1."""
    rows = spark.read.schema(EXTERNAL).json(path).join(known.select(F.col("doc_key").alias("doc_name")), "doc_name", "left_semi")
    return rows.select(F.col("financebench_id").alias("qid"), "question", "doc_name", F.transform("evidence", lambda e: F.struct(e["doc_name"].alias("doc"), (e["evidence_page_num"] + 1).alias("page"))).alias("evidence"))


def runs(names: DataFrame, column: str = "file_name") -> DataFrame:
    """stamp, name of stamped result files, without grid cells and batches, the newest first."""
    rows = names.select(F.regexp_extract(column, STAMPED, 1).alias("stamp"), F.regexp_extract(column, STAMPED, 2).alias("name")).where("stamp <> ''")
    return rows.where(~F.col("name").startswith("abl-") & ~F.col("name").endswith("-batch")).orderBy(F.desc("stamp"), "name")


def latest(names: DataFrame, pattern: str, column: str = "file_name") -> DataFrame:
    return names.where(F.col(column).rlike(pattern)).agg(F.max(column).alias(column))


class _Blocks(HTMLParser):
    """Text of headings, paragraphs and list items, in sequence; scripts and styles are skipped."""

    KEPT, SKIPPED = {"title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li"}, {"script", "style"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.tag, self.text, self.skip = None, [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIPPED
        if tag in self.KEPT:
            self.close_block()
            self.tag = tag

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIPPED and self.skip > 0
        if tag == self.tag:
            self.close_block()

    def handle_data(self, data):
        if self.tag and not self.skip:
            self.text.append(data)

    def close_block(self):
        if self.tag and (text := " ".join("".join(self.text).split())):
            self.found.append((self.tag, text))
        self.tag, self.text = None, []


def html_blocks(html: str) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close_block()
    return parser.found


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _PageReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.extension in ("html", "htm")]

    def read(self, partition):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_stream(partition.path) as f:
            blocks = html_blocks(f.read().decode("utf-8", "replace"))
        for n, (tag, text) in enumerate(blocks):
            yield partition.path, n, tag, text


class PageSource(DataSource):
    """spark.read.format("gleanery_pages").load(folder URI): a row for each block of each HTML file."""

    @classmethod
    def name(cls) -> str:
        return "gleanery_pages"

    def schema(self) -> str:
        return "path string, block_index int, tag string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
