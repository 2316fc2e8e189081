"""Screening of passages and policy for answers, by patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an attempt to address the model, by name.
SIGNALS = {
    "override": r"(?i)\b(?:ignore|disregard|forget|override)\b[^.\n]{0,40}\b(?:previous|prior|above|earlier|all|these|your|the)\b[^.\n]{0,20}\b(?:instructions?|rules?|prompts?|directions?)\b",
    "addresses_model": r"(?i)\b(?:assistant|AI model|language model|LLM|chatbot)\b[^.\n]{0,40}\b(?:must|should|shall|will|needs? to|is instructed)\b",
    "role_marker": r"(?i)(?:^|\n)\s*(?:system|assistant|user|developer)\s*(?:prompt|message|note)?\s*:",
    "system_prompt": r"(?i)\b(?:system prompt|system override|new instructions?|jailbreak)\b",
    "refusal_token": r"\bINSUFFICIENT_CONTEXT\b",
    "markdown_image": r"!\[[^\]]*\]\(",
    "respond_with": r"(?i)\b(?:respond|reply|answer|begin your (?:answer|response))\b[^.\n]{0,30}\b(?:with|by saying|exactly|only)\b[^.\n]{0,10}[\"'“‘]",
}
# What the answer policy removes, and tags and headers that a source must not forge.
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
TAG = r"(?i)<\s*(?:img|a|script|iframe)\b[^>]*>"
LINK = r"\[([^\]]+)\]\((?:https?:|www\.|//)[^)]*\)"
URL = r"(?i)\b(?:https?://|www\.)[^\s<>()\"']+"
URL_STANDS_AS = "[link removed]"
#: The answer policy, rule by rule in this order: pattern, what stands in its place ($1: its first group), what it counts as.
POLICY = ((IMAGE, "", "images"), (TAG, "", "images"), (LINK, "$1", "links"), (URL, URL_STANDS_AS, "links"))
FENCE_TAG = r"(?i)<\s*(/?)\s*(source|sources|question|system|instructions)\b"
FORGED_HEADER = r"(?im)^(\s*)\[(\d+)\](?=[^\n]*\b(?:10-K|page|Form)\b)"
REFUSAL_TOKEN = "INSUFFICIENT_CONTEXT"


def signals(text: Column) -> Column:
    """Names of the patterns found in the text, in the table's order; none in a null text."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in SIGNALS.items())))


def bad_controls(text: Column) -> Column:
    """True if a control character other than tab and line ends is in the text."""
    return text.rlike(r"[\p{Cc}&&[^\n\t\r]]")


def without_format_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cf}", "")


def defuse(text: Column) -> tuple[Column, Column]:
    """The text with forged fences and headers made harmless, and how many there were."""
    fences = F.regexp_replace(text, FENCE_TAG, "‹$1$2")
    return F.regexp_replace(fences, FORGED_HEADER, "$1($2)"), F.regexp_count(text, F.lit(FENCE_TAG)) + F.regexp_count(fences, F.lit(FORGED_HEADER))


def answer_policy(text: Column) -> tuple[Column, Column, Column]:
    """The answer without images, tags, link targets and URLs; images and tags removed; links and URLs removed."""
    counts = {"images": F.lit(0), "links": F.lit(0)}
    for pattern, stand_in, kind in POLICY:
        counts[kind] = counts[kind] + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, stand_in)
    return text, counts["images"], counts["links"]


def is_refusal(text: Column) -> Column:
    """The token stands in the text as a word, and no citation does."""
    token = rf"(?i)(?<![A-Za-z0-9_]){REFUSAL_TOKEN}(?![A-Za-z0-9_])"
    rest = F.regexp_replace(F.regexp_replace(text, token, ""), "[【】]", "|")
    return text.rlike(token) & ~rest.rlike(r"\[\d+(?:\s*,\s*\d+)*\]|\|\s*\d+(?:\s*[,，]\s*\d+)*\s*\|")


def source_header(n: Column, company: Column, year: Column, form: Column, page: Column, page_end: Column, section: Column) -> Column:
    """[n] company year Form form · page p · section › section"""
    pages = F.when(page == page_end, F.concat(F.lit("page "), page)).otherwise(F.concat(F.lit("pages "), page, F.lit("–"), page_end))
    return F.concat_ws(" · ", F.concat(F.lit("["), n, F.lit("] "), company, F.lit(" "), year, F.lit(" Form "), form), pages, F.when(F.size(section) > 0, F.array_join(section, " › ")))


def fenced(n: Column, header: Column, text: Column) -> Column:
    return F.concat(F.lit('<source id="'), n, F.lit('">\n'), header, F.lit("\n"), text, F.lit("\n</source>"))
