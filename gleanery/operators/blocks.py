"""Documents from blocks: HTML pages as blocks, headings, section paths, canonical text and offsets, running lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, edge_key

SEPARATOR = "\n\n"
# Headings and statements of annual reports.
PART = r"(?i)^part\s+(i{1,3}|iv)\b"
ITEM = r"(?i)^item\s+(\d{1,2}[a-c]?)\s*[.:\-—–]"
ITEM_LINE = r"(?im)^\s*item\s+(\d{1,2}[a-c]?)\s*[.:\-—–]"
SIGNATURE = r"(?i)pursuant to the requirements of section 13"
PAGE_NUMBER = r"(?i)^(page\s+)?\d{1,4}$"
CURRENCY = ("$", "€", "£")

_TAGS = r"(?is)<(h[1-6]|p|li|title)\b[^>]*>(.*?)</\1\s*>"


def unescaped(text: Column) -> Column:
    """The five named entities and the no-break space."""
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def page_blocks(pages: DataFrame, *, id: str = "page_id", html: str = "html") -> DataFrame:
    """id, block_index, tag, heading_level (0 to 3), text: a block for each title, heading, paragraph and list item.

    Scripts, styles and comments are left out; blocks without text too. h1 is level 1, h2 2, h3 and beyond 3."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    found = F.transform(F.regexp_extract_all(body, F.lit(_TAGS), F.lit(0)), lambda x: F.struct(F.lower(F.regexp_extract(x, _TAGS, 1)).alias("tag"), collapse(unescaped(F.regexp_replace(F.regexp_extract(x, _TAGS, 2), r"(?s)<[^>]*>", " "))).alias("text")))
    rows = pages.select(F.col(id).alias("id"), F.posexplode(F.filter(found, lambda x: x["text"] != "")).alias("block_index", "_b"))
    level = F.when(F.col("_b.tag").rlike("^h[1-6]$"), F.least(F.lit(3), F.substring("_b.tag", 2, 1).cast("int"))).otherwise(0)
    return rows.select("id", "block_index", F.col("_b.tag").alias("tag"), level.alias("heading_level"), F.col("_b.text").alias("text"))


def heading_class(text: Column, bold: Column, size: Column, body_size: Column, kind: Column | None = None) -> Column:
    """0 none, 1 PART, 2 ITEM, 3 another heading: short, styled, wordy, without figures, not ending like a sentence."""
    styled = bold | (size >= body_size * 1.2)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    other = styled & (F.size(F.split(F.trim(text), r"\s+")) >= 2) & ~text.rlike(r"\d") & (letters >= 0.7 * F.length(text)) & ~text.rlike(r"[.,;]$") & ~text.startswith("(")
    level = F.when(text.rlike(PART) & (F.length(text) <= 40), 1).when(text.rlike(ITEM) & styled, 2).when(other, 3).otherwise(0)
    usable = (F.length(text) <= 150) & ((kind == "text") if kind is not None else F.lit(True))
    return F.when(usable, level).otherwise(0)


def body_size(blocks: DataFrame, by: str = "id") -> DataFrame:
    """by, body_size: the size with the most characters (1 digit), the smallest of equals."""
    sums = blocks.groupBy(by, F.bround("max_size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return sums.groupBy(by).agg(F.max_by("size", F.struct("chars", (-F.col("size")).alias("less"))).alias("body_size"))


def section_paths(blocks: DataFrame, by: str = "id", order: str = "block_index", levels: int = 3) -> DataFrame:
    """blocks with `section`: the headings above each block. A heading closes those of its own level and below."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks
    for k in range(1, levels + 1):
        mark = F.when(F.col("heading_level") == k, F.struct(order, "text"))
        rows = rows.withColumn(f"_h{k}", F.last(mark, ignorenulls=True).over(upto)).withColumn(f"_c{k}", F.max(F.when((F.col("heading_level") >= 1) & (F.col("heading_level") < k), F.col(order))).over(upto))
    parts = [F.when(F.col(f"_h{k}").isNotNull() & (F.col(f"_c{k}").isNull() | (F.col(f"_h{k}.{order}") > F.col(f"_c{k}"))), F.col(f"_h{k}.text")) for k in range(1, levels + 1)]
    return rows.withColumn("section", F.array_compact(F.array(*parts))).drop(*[f"_{x}{k}" for x in "hc" for k in range(1, levels + 1)])


def block_offsets(blocks: DataFrame, by: str = "id", order: str = "block_index") -> DataFrame:
    """blocks with char_start and char_end in the canonical text, where two line feeds part blocks."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + len(SEPARATOR)).over(before), F.lit(0))
    return blocks.withColumn("char_start", start.cast("int")).withColumn("char_end", F.col("char_start") + F.length("text"))


def canonical_text(blocks: DataFrame, by: str = "id", order: str = "block_index") -> DataFrame:
    """by, canonical_text. One document's blocks meet in one row."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return blocks.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["text"]), SEPARATOR).alias("canonical_text"))


def offset_violations(blocks: DataFrame, texts: DataFrame, by: str = "id") -> DataFrame:
    """Blocks that are not the text at their offsets."""
    return blocks.join(texts, by).where(F.substring("canonical_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("text"))


def running_lines(lines: DataFrame, share: float = 0.1, least: int = 5, by: str = "doc", page: str = "page") -> DataFrame:
    """by, key, pages: lines on at least max(least, floor(share * pages)) distinct pages. lines: by, page, line."""
    pages = lines.groupBy(by).agg(F.count_distinct(page).alias("_all"))
    keys = lines.groupBy(by, edge_key(F.col("line")).alias("key")).agg(F.count_distinct(page).alias("pages"))
    return keys.join(pages, by).where(F.col("pages") >= F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("_all")))).select(by, "key", "pages")


def without_running_lines(lines: DataFrame, running: DataFrame, by: str = "doc") -> DataFrame:
    keyed = lines.withColumn("key", edge_key(F.col("line")))
    return keyed.join(running.select(by, "key"), [by, "key"], "left_anti").drop("key")


def page_regions(pages: DataFrame, by: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """pages with region: after_signatures beyond the first page with the signature statement, body otherwise."""
    first = F.min(F.when(F.col(text).rlike(SIGNATURE), F.col(page))).over(Window.partitionBy(by))
    return pages.withColumn("region", F.when(F.col(page) > first, "after_signatures").otherwise("body"))


def without_page_numbers(blocks: DataFrame, by: list[str], order: str = "block_index") -> DataFrame:
    """blocks without the last of a page where that is a page number."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return blocks.withColumn("_last", last).where(~((F.col("_last") == 1) & F.trim("text").rlike(PAGE_NUMBER))).drop("_last")


def is_prose(text: Column) -> Column:
    return (F.length(text) >= 80) & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 0.6 * F.length(text))


def table_row(cells: Column) -> Column:
    """Cells without the empty ones, a lone currency sign joined to the next, parted by ' | '."""
    full = F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    sign = lambda acc: (F.size(acc) > 0) & F.element_at(acc, -1).isin(*CURRENCY)
    step = lambda acc, c: F.when(F.when(F.size(acc) > 0, sign(acc)).otherwise(F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), c)))).otherwise(F.concat(acc, F.array(c)))
    return F.array_join(F.aggregate(full, F.array().cast("array<string>"), step), " | ")


def reading_order(blocks: DataFrame, width: str = "width") -> DataFrame:
    """blocks (id, page, x0, y0, x1, text, width) with reading_index and two_columns. A page has two columns if a line at
    35 to 65 % of its width, the first such one, is crossed by no block at all and has three blocks of prose on each side:
    then the blocks left of it come first, each side from the top. Other pages are read by row, tops rounded."""
    lines = blocks.withColumn("_x", F.explode(F.sequence(F.lit(35), F.lit(65)))).withColumn("_at", F.col(width) * F.col("_x") / 100)
    prose, left, right = is_prose(F.col("text")), F.col("x1") <= F.col("_at"), F.col("x0") >= F.col("_at")
    sides = lines.groupBy("id", "page", "_x").agg(F.count_if(prose & left).alias("l"), F.count_if(prose & right).alias("r"), F.count_if((F.col("x0") < F.col("_at")) & (F.col("x1") > F.col("_at"))).alias("across"))
    gutter = sides.where("l >= 3 AND r >= 3 AND across = 0").groupBy("id", "page").agg(F.min("_x").alias("_g"))
    rows = blocks.join(gutter, ["id", "page"], "left").withColumn("two_columns", F.col("_g").isNotNull())
    side = F.when(F.col("two_columns") & (F.col("x1") > F.col(width) * F.col("_g") / 100), 1).otherwise(0)
    top = F.when(F.col("two_columns"), F.col("y0")).otherwise(F.bround("y0", 0))
    return rows.withColumn("reading_index", F.row_number().over(Window.partitionBy("id", "page").orderBy(side, top, "x0")) - 1).drop("_g")


def item_pages(pages: DataFrame, expected: list[str]) -> tuple[DataFrame, DataFrame]:
    """doc, item, pages; and for each document the expected items that are missing."""
    found = pages.select("doc", "page", F.explode(F.regexp_extract_all("text", F.lit(ITEM_LINE), F.lit(1))).alias("item")).select("doc", "page", F.upper("item").alias("item"))
    by_item = found.groupBy("doc", "item").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    have = pages.select("doc").distinct().join(by_item.groupBy("doc").agg(F.collect_set("item").alias("_have")), "doc", "left")
    missing = have.select("doc", F.array_except(F.array(*map(F.lit, expected)), F.coalesce("_have", F.array().cast("array<string>"))).alias("missing"))
    return by_item, missing


def first_page(pages: DataFrame, pattern: str, after: int = 0) -> DataFrame:
    return pages.where(F.col("text").rlike(pattern) & (F.col("page") > after)).groupBy("doc").agg(F.min("page").alias("page"))
