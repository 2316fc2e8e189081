"""Registered queries of blocks, sources, filters and reports over the test tables, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.citations import page_label
from ..functions.text import edge_key, normalise
from ..operators import answers, blocks, embeddings, evaluation, filters, intervals, ranking, request_log, statistics, store
from ..sources import files, tables
from ..sources.stored import folder_once, shared_dir
from ..sources.tables import table
from ..streaming.events import parse_sse
from .evaluation import _C, ROOM, chunks
from .ingest import ORACLES as INGEST


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def attack_success(spark, d):
    rows = table(spark, d, "labels").select(F.concat(F.lit("A"), F.col("doc_id") % 3).alias("attack"), (F.col("quality") == 1).alias("v1"), (F.col("toxic") == 1).alias("full"))
    return evaluation.attack_counts(rows, ["v1", "full"])


def chunk_set_ids(spark, d):
    """Nations of the first two regions have ids; the others get the next ones."""
    sets = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("strategy"), F.col("n_regionkey").cast("int").alias("chunk_size"))
    return store.get_or_create(sets.where("chunk_size < 2"), sets, ["strategy", "chunk_size"])


def citation_labels(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("page"), (F.col("l_linenumber") + (F.col("l_quantity") > 25).cast("int")).alias("page_end")).distinct()
    return rows.select("page", "page_end", page_label(F.col("page"), F.col("page_end")).alias("label"))


def covered_blocks(spark, d):
    """Customers as blocks on the page of their nation, which has one table."""
    k = F.col("c_custkey")
    b = table(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("page"), (k * 7 % 200).cast("double").alias("x0"), (k * 11 % 300).cast("double").alias("y0"), (k * 7 % 200 + 20).cast("double").alias("x1"), (k * 11 % 300 + 10).cast("double").alias("y1"))
    n = F.col("n_nationkey")
    t = table(spark, d, "nation").select(n.alias("page"), (n * 3).cast("double").alias("bx0"), (n * 2).cast("double").alias("by0"), (n * 3 + 100).cast("double").alias("bx1"), (n * 2 + 150).cast("double").alias("by1"))
    return intervals.centre_inside(b, t, "page").select("id")


def edge_keys(spark, d):
    lines = table(spark, d, "conversations").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(edge_key(normalise(F.col("line"))).alias("key")).agg(F.count("*").alias("n"))


def heading_classes(spark, d):
    rows = blocks.page_blocks(table(spark, d, "pages"))
    return rows.select("id", "block_index", blocks.heading_class(F.col("text"), F.col("tag").startswith("h"), F.lit(10.0), F.lit(10.0)).alias("level"))


ITEMS = ["1", "2", "4", "8", "9A"]


def item_presence(spark, d):
    rows = documents(spark, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.concat(F.lit("Item "), F.col("doc_id") * 7 % 10, F.lit(". x\n"), "text").alias("text"))
    found, missing = blocks.item_pages(rows, ITEMS)
    return missing.join(found.groupBy("doc").agg(F.count("*").alias("found")), "doc", "left").select("doc", F.array_join("missing", ",").alias("missing"), F.coalesce("found", F.lit(0).cast("long")).alias("found"))


def first_item_page(spark, d):
    rows = documents(spark, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.concat(F.lit("Item "), F.col("doc_id") * 7 % 10, F.lit(". x")).alias("text"))
    return blocks.first_page(rows, r"(?i)^item\s+8\b", 20)


def judge_scores(spark, d):
    """Replies of judges made from the documents' numbers; every seventh one isn't JSON."""
    k = F.col("doc_id")
    claims = F.array_join(F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, (k % 4).cast("int")), lambda i: F.concat(F.lit('{"supported":'), ((k + i) % 3 == 0).cast("string"), F.lit("}"))), ",")
    verdict = F.get(F.array(*map(F.lit, [*statistics.VERDICTS, "odd"])), (k % (len(statistics.VERDICTS) + 1)).cast("int"))
    rows = documents(spark, d).select(k.alias("id"), F.when(k % 7 == 0, "no").otherwise(F.concat(F.lit('{"claims":['), claims, F.lit("]}"))).alias("faithfulness_json"), F.concat(F.lit('{"score":'), k % 8, F.lit("}")).alias("relevance_json"), F.concat(F.lit('{"verdict":"'), verdict, F.lit('"}')).alias("correctness_json"))
    return statistics.quality_scores(rows).select("id", F.round("faithfulness", 6).alias("faithfulness"), F.round("relevance", 6).alias("relevance"), "correctness")


def laundered_claims(spark, d):
    k = F.col("item_id")
    rows = table(spark, d, "benchmark").select(k.alias("qid"), F.concat(F.lit("It is "), k, F.lit(" ["), k % 3 + 1, F.lit("].")).alias("sentence"), F.when(k % 5 == 0, "elsewhere").otherwise(k.cast("string")).alias("marker"), F.array(F.lit(2)).alias("poison"))
    return answers.laundered(rows)


def page_numbers_dropped(spark, d):
    """Lines left of the documents, of which every second one ends with a page number."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\nPage "), F.col("doc_id") % 5000)).otherwise(F.col("text"))
    rows = documents(spark, d).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split(text, "\n")).alias("block_index", "text"))
    return blocks.without_page_numbers(rows, ["doc", "page"]).groupBy("doc").agg(F.count("*").alias("lines"))


def page_regions(spark, d):
    text = F.when(F.col("doc_id") % 17 == 5, F.concat("text", F.lit(" Pursuant to the requirements of Section 13"))).otherwise(F.col("text"))
    rows = documents(spark, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), text.alias("text"))
    return blocks.page_regions(rows).select("doc", "page", "region")


def _file_names(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T000000Z_"), F.when(k % 5 == 0, "abl-").otherwise(""), k.cast("string"), F.when(k % 7 == 0, "-batch").otherwise(""), F.when(k % 3 == 0, ".csv").otherwise(".json"))
    return table(spark, d, "orders").select(name.alias("file_name"))


def run_listing(spark, d):
    return files.runs(_file_names(spark, d))


def latest_file(spark, d):
    return files.latest(_file_names(spark, d), r"_abl-\d+\.csv$")


def sse_events(spark, d):
    """The turns as event streams: an event's name, a data line for each line of its text, a blank line."""
    t = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("stream"), "turn", F.concat(F.array(F.concat(F.lit("event: "), "role"), F.lit(": comment")), F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("data: "), x)), F.array(F.lit(""))).alias("lines"))
    rows = t.select("stream", "turn", F.posexplode("lines").alias("_i", "line")).select("stream", (F.col("turn") * 1_000_000 + F.col("_i")).alias("line_no"), "line")
    return parse_sse(rows).select("stream", "event", F.sha2("data", 256).alias("data"))


def table_rows(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array("s_name", F.lit("$"), F.col("s_acctbal").cast("string"), F.lit(" "), F.lit(None).cast("string"), F.lit(" end "), F.lit("€")).alias("cells"))
    return rows.select("id", blocks.table_row(F.col("cells")).alias("text"))


def two_column_order(spark, d):
    """Customers as paragraphs, twelve a page, left and right; every second page has a heading across."""
    k = F.col("c_custkey")
    across = (F.floor(k / 12) % 2 == 0) & (k % 12 == 5)
    x0 = F.when(across | (k % 2 == 0), 40.0).otherwise(310.0)
    rows = table(spark, d, "customer").select(F.lit(1).alias("id"), F.floor(k / 12).alias("page"), k.alias("block"), x0.alias("x0"), (k * 37 % 500 + 0.25).cast("double").alias("y0"), F.when(across, 560.0).otherwise(x0 + 240).alias("x1"), F.when(across, "Heading").otherwise(F.lit("prose " * 16)).alias("text"), F.lit(600.0).alias("width"))
    return blocks.reading_order(rows).select("page", "block", "reading_index", "two_columns")


def unknown_sources(spark, d):
    return filters.unknown_values(table(spark, d, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("source")), documents(spark, d), "source")


def partition_rows(spark, d):
    return documents(spark, d).where(filters.in_partition(lang="en", source="src1")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def labelled_rows(spark, d):
    return filters.exists_in(documents(spark, d), table(spark, d, "labels"), ["doc_id"]).groupBy("source").agg(F.count("*").alias("n"))


def chunk_location(spark, d):
    """One chunk by its id: where it is."""
    return filters.lookup(chunks(spark, d), id=7 * ROOM).select("doc", "char_start", "char_end")


def first_documents(spark, d):
    return filters.first_rows(documents(spark, d), 25, "n_chars", "doc_id").select("doc_id")


def wanted_documents(spark, d):
    return filters.wanted_ids(documents(spark, d), [3, 5, 8], "doc_id").select("doc_id", "source")


def result_page(spark, d):
    """The third page of twenty orders, the dearest first."""
    return ranking.result_page(table(spark, d, "orders"), 20, 40, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey")


def query_embeddings(spark, d):
    """Unit vectors of the questions, as their squared lengths."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return embeddings.embed_queries(q).select("qid", F.size("qvec").alias("dims"), F.round(F.aggregate("qvec", F.lit(0.0), lambda a, x: a + x * x), 4).alias("square"))


def model_keys(spark, d):
    return table(spark, d, "nation").select(embeddings.model_key(F.col("n_name"), F.sha2("n_name", 256)).alias("model"))


def report_columns(spark, d):
    """Results with different columns in one report."""
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("zeta"), F.lit("nation").alias("type"))
    b = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("alpha"), F.lit("region").alias("type"))
    return tables.report_columns([a, b])


def pending_configs(spark, d):
    """Customers' nations as configurations, suppliers' nations as those with a result."""
    name = lambda t, c: table(spark, d, t).select(F.col(c).cast("string").alias("config"), F.lit("h").alias("label_sha")).distinct()
    return statistics.pending(name("nation", "n_nationkey"), name("supplier", "s_nationkey")).select("config")


def log_lines(spark, d):
    return request_log.log_lines(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), (F.col("n_regionkey") > 2).alias("late")))


def provenance(spark, d):
    rows = tables.with_provenance(table(spark, d, "region").select("r_name"), "sha", "abc", True, {"k": 10, "mode": "hybrid"}, 1.5)
    return rows.select("r_name", "label_sha", "commit", "dirty", F.col("config")["k"].alias("k"), F.size("config").alias("n"), "wall_seconds")


def golden_file(spark, d):
    """The benchmark as a file of labelled questions, read back quote by quote."""
    quote = lambda doc, text: F.struct(doc.cast("string").alias("doc"), text.alias("quote"))
    k = F.col("item_id")
    rows = table(spark, d, "benchmark").select(k.cast("string").alias("id"), F.lit("factual").alias("type"), F.col("text").alias("question"), F.array(F.array(quote(k, F.substring("text", 1, 20)), quote(k + 1, F.lit("x"))), F.array(quote(k + 2, F.lit("y")))).alias("evidence"))
    folder = folder_once(spark, (d, "golden"), lambda f: rows.write.json(f))
    return files.golden_quotes(files.golden(spark, folder))


def external_file(spark, d):
    """Questions of another set, of which only those on known documents stay; pages count from 1."""
    k = F.col("item_id")
    rows = table(spark, d, "benchmark").select(k.cast("string").alias("financebench_id"), F.col("text").alias("question"), F.concat(F.lit("src"), k % 30).alias("doc_name"), F.array(F.struct(F.concat(F.lit("src"), k % 30).alias("doc_name"), (k % 9).cast("int").alias("evidence_page_num"))).alias("evidence"))
    folder = folder_once(spark, (d, "external"), lambda f: rows.write.json(f))
    found = files.external(spark, folder, documents(spark, d).select(F.col("source").alias("doc_key")).distinct())
    return found.select("qid", "doc_name", F.col("evidence")[0]["page"].alias("page"))


def bulk_load(spark, d):
    """Documents loaded by language, then those of one language again, shortened: only their partition changes."""
    folder = shared_dir(spark)
    docs = documents(spark, d).select("doc_id", F.length("text").alias("n"), F.coalesce("lang", F.lit("none")).alias("lang"))
    tables.load(docs, folder, ["lang"])
    tables.load(docs.where("lang = 'en'").withColumn("n", F.lit(1)), folder, ["lang"])
    return spark.read.parquet(folder).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


def appended_log(spark, d):
    """Two appends of log rows with some columns; the others take their defaults."""
    folder = shared_dir(spark)
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("request_id"), F.lit(200).alias("status"))
    tables.log_row(rows, folder)
    tables.log_row(rows.withColumn("input_tokens", F.lit(3)), folder)
    return spark.read.schema(tables.SCHEMAS["request_log"]).parquet(folder).agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"), F.count_if(F.col("cached")).alias("cached"), F.count("refused").alias("refusals_known"))


_VERDICT = " ".join(f"WHEN {k} THEN {float(v)}" for k, v in enumerate(statistics.VERDICTS.values()))
_NAMES = "f AS (SELECT strftime(o_orderdate, '%Y%m%d') || 'T000000Z' AS stamp, CASE WHEN o_orderkey % 5 = 0 THEN 'abl-' ELSE '' END || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '-batch' ELSE '' END AS name, CASE WHEN o_orderkey % 3 = 0 THEN '.csv' ELSE '.json' END AS ending FROM orders)"
QUERIES = {f.__name__: f for f in (attack_success, chunk_set_ids, citation_labels, covered_blocks, edge_keys, heading_classes, item_presence, first_item_page, judge_scores, laundered_claims, page_numbers_dropped, page_regions, run_listing, latest_file, sse_events, table_rows, two_column_order, unknown_sources, partition_rows, labelled_rows, chunk_location, first_documents, wanted_documents, result_page, query_embeddings, model_keys, report_columns, pending_configs, log_lines, provenance, golden_file, external_file, bulk_load, appended_log)}
ORACLES = {
    "attack_success": "SELECT 'A' || (doc_id % 3) AS attack, count(*) AS n, count(*) FILTER (quality = 1) AS v1, count(*) FILTER (toxic = 1) AS \"full\" FROM labels GROUP BY ALL",
    "chunk_set_ids": "SELECT n_name AS strategy, n_regionkey AS chunk_size, CASE WHEN n_regionkey < 2 THEN n_nationkey ELSE (SELECT max(n_nationkey) FROM nation WHERE n_regionkey < 2) + row_number() OVER (PARTITION BY n_regionkey < 2 ORDER BY n_name) END AS id FROM nation",
    "citation_labels": "SELECT DISTINCT l_linenumber AS page, l_linenumber + (l_quantity > 25)::INT AS page_end, CASE WHEN l_quantity > 25 THEN 'pp. ' || l_linenumber || '–' || (l_linenumber + 1) ELSE 'p. ' || l_linenumber END AS label FROM lineitem",
    "covered_blocks": """SELECT c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE NOT (c_custkey * 7 % 200 + 10 BETWEEN n_nationkey * 3 - 2 AND n_nationkey * 3 + 102 AND c_custkey * 11 % 300 + 5 BETWEEN n_nationkey * 2 - 2 AND n_nationkey * 2 + 152)""",
    "edge_keys": r"""SELECT regexp_replace(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '\d+', '#', 'g'), '^#\s+|\s+#$', '', 'g') AS key, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY ALL""",
    "heading_classes": rf"""WITH b AS ({INGEST["page_blocks"]}) SELECT id, block_index, CASE WHEN length(text) > 150 THEN 0 WHEN regexp_matches(text, '{blocks.PART}') AND length(text) <= 40 THEN 1
WHEN regexp_matches(text, '{blocks.ITEM}') AND starts_with(tag, 'h') THEN 2
WHEN starts_with(tag, 'h') AND contains(trim(text), ' ') AND NOT regexp_matches(text, '\d') AND length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 0.7 * length(text) AND NOT regexp_matches(text, '[.,;]$') AND NOT starts_with(text, '(') THEN 3 ELSE 0 END AS level FROM b""",
    "item_presence": f"""WITH f AS (SELECT DISTINCT source, upper(unnest(regexp_extract_all('Item ' || (doc_id * 7 % 10) || '. x' || chr(10) || coalesce(text, ''), '{blocks.ITEM_LINE}', 1))) AS item FROM documents),
l AS (SELECT source, list(item) AS have FROM f GROUP BY ALL) SELECT source AS doc, array_to_string(list_filter({ITEMS}, lambda x: NOT list_contains(have, x)), ',') AS missing, len(have) AS found FROM l""",
    "first_item_page": "SELECT source AS doc, min(doc_id) AS page FROM documents WHERE doc_id * 7 % 10 = 8 AND doc_id > 20 GROUP BY ALL",
    "judge_scores": f"""SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 OR doc_id % 4 = 0 THEN NULL ELSE round(len(list_filter(range(0, doc_id % 4), lambda i: (doc_id + i) % 3 = 0)) / (doc_id % 4), 6) END AS faithfulness,
round((least(5, greatest(1, doc_id % 8)) - 1) / 4, 6) AS relevance, CASE doc_id % {len(statistics.VERDICTS) + 1} {_VERDICT} END::DOUBLE AS correctness FROM documents""",
    "laundered_claims": "SELECT item_id AS qid, item_id % 5 <> 0 AND item_id % 3 <> 1 AS laundered FROM benchmark",
    "page_numbers_dropped": rf"""WITH l AS (SELECT doc_id AS doc, string_split(text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Page ' || (doc_id % 5000) ELSE '' END, chr(10)) AS l FROM documents),
n AS (SELECT doc, len(l) - regexp_matches(trim(l[-1]), '{blocks.PAGE_NUMBER}')::INT AS lines FROM l) SELECT * FROM n WHERE lines > 0""",
    "page_regions": f"""WITH p AS (SELECT source, doc_id, doc_id % 17 = 5 OR regexp_matches(text, '{blocks.SIGNATURE}') AS s FROM documents)
SELECT source AS doc, doc_id AS page, CASE WHEN doc_id > min(doc_id) FILTER (s) OVER (PARTITION BY source) THEN 'after_signatures' ELSE 'body' END AS region FROM p""",
    "run_listing": f"WITH {_NAMES} SELECT stamp, name FROM f WHERE ending = '.json' AND NOT starts_with(name, 'abl-') AND NOT ends_with(name, '-batch')",
    "latest_file": rf"WITH {_NAMES} SELECT max(stamp || '_' || name || ending) AS file_name FROM f WHERE regexp_matches(name || ending, '^abl-\d+\.csv$')",
    "sse_events": "SELECT conv_id::VARCHAR AS stream, role AS event, sha256(text) AS data FROM conversations WHERE text IS NOT NULL",
    "table_rows": "SELECT s_suppkey AS id, s_name || ' | $' || s_acctbal || ' | end | €' AS text FROM supplier",
    "two_column_order": """WITH k AS (SELECT c_custkey AS block, c_custkey // 12 AS page, (c_custkey // 12) % 2 = 0 AND c_custkey % 12 = 5 AS a FROM customer),
b AS (SELECT *, CASE WHEN a OR block % 2 = 0 THEN 40 ELSE 310 END AS x0, block * 37 % 500 AS y, CASE WHEN a THEN 560 WHEN block % 2 = 0 THEN 280 ELSE 550 END AS x1 FROM k),
x AS (SELECT page, g FROM (SELECT b.*, 6 * f AS g FROM b, range(35, 66) t(f)) GROUP BY page, g HAVING count(*) FILTER (NOT a AND x1 <= g) >= 3 AND count(*) FILTER (NOT a AND x0 >= g) >= 3 AND count(*) FILTER (x0 < g AND x1 > g) = 0),
m AS (SELECT page, min(g) AS g FROM x GROUP BY ALL)
SELECT page, block, row_number() OVER (PARTITION BY page ORDER BY coalesce((x1 > g)::INT, 0), y, x0) - 1 AS reading_index, g IS NOT NULL AS two_columns FROM b LEFT JOIN m USING (page)""",
    "unknown_sources": "SELECT DISTINCT 'src' || n_nationkey AS source FROM nation WHERE 'src' || n_nationkey NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)",
    "partition_rows": "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang = 'en' AND source = 'src1'",
    "labelled_rows": "SELECT source, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) GROUP BY ALL",
    "chunk_location": f"WITH {_C} SELECT doc, char_start, char_end FROM c WHERE id = {7 * ROOM}",
    "first_documents": "SELECT doc_id FROM documents ORDER BY n_chars NULLS FIRST, doc_id LIMIT 25",
    "wanted_documents": "SELECT doc_id, source FROM documents WHERE doc_id IN (3, 5, 8)",
    "result_page": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "query_embeddings": "SELECT item_id AS qid, 64 AS dims, 1.0::DOUBLE AS square FROM benchmark",
    "model_keys": "SELECT n_name || '@' || left(sha256(n_name), 8) AS model FROM nation",
    "report_columns": "SELECT n_nationkey AS id, 'nation' AS type, NULL AS alpha, n_name AS zeta FROM nation UNION ALL SELECT r_regionkey, 'region', r_name, NULL FROM region",
    "pending_configs": "SELECT n_nationkey::VARCHAR AS config FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
    "log_lines": """SELECT '{"key":' || n_nationkey || ',"name":"' || n_name || '","late":' || (n_regionkey > 2)::VARCHAR || '}' AS value FROM nation""",
    "provenance": "SELECT r_name, 'sha' AS label_sha, 'abc' AS commit, true AS dirty, '10' AS k, 2 AS n, 1.5::DOUBLE AS wall_seconds FROM region",
    "golden_file": "SELECT item_id::VARCHAR AS qid, item, alternative, (item_id + 2 * item + alternative)::VARCHAR AS doc, CASE WHEN item = 1 THEN 'y' WHEN alternative = 1 THEN 'x' ELSE substr(text, 1, 20) END AS quote FROM benchmark, (VALUES (0, 0), (0, 1), (1, 0)) AS v(item, alternative)",
    "external_file": "SELECT item_id::VARCHAR AS qid, 'src' || (item_id % 30) AS doc_name, (item_id % 9 + 1)::INT AS page FROM benchmark WHERE 'src' || (item_id % 30) IN (SELECT source FROM documents WHERE source IS NOT NULL)",
    "bulk_load": "SELECT coalesce(lang, 'none') AS lang, count(*) AS docs, sum(CASE WHEN lang = 'en' THEN 1 ELSE length(text) END)::BIGINT AS n FROM documents GROUP BY ALL",
    "appended_log": "SELECT 2 * count(*) AS n, 3 * count(*) AS tokens, 0 AS cached, 0 AS refusals_known FROM events",
}
