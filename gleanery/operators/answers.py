"""From passages to checked answers: screening, packing, extractive answers, citations, caching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import guard as G
from ..functions.text import LEXEME
from ..settings import ORDERS, SCREENS, one_of
from .ranking import presentation_position, ranked

# Question words that carry no content.
QUESTION_STOP = "a an the of in on for to and or is was were be by with as at from that this what which how did does do has have had its it are fy fiscal year company".split()
LEAST_SHARED = 2


def tokens_in(text: Column) -> Column:
    """Token count of the plain counter: words, and other visible characters one by one."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def screened(hits: DataFrame, mode: str = "drop", text: str = "text") -> DataFrame:
    """hits with signals (names of the patterns found) and quarantined. drop sets hits apart that have any, flag only
    names them, off looks at none."""
    one_of("screen", mode, SCREENS)
    found = F.array().cast("array<string>") if mode == "off" else G.signals(F.col(text))
    rows = hits.withColumn("signals", found)
    return rows.withColumn("quarantined", (F.size("signals") > 0) if mode == "drop" else F.lit(False))


def rendered(hits: DataFrame, template: str = "2", text: str = "text") -> DataFrame:
    """hits with `body` (defused in template 2) and `defused` (edits). Numbers come with the final order."""
    trimmed = F.trim(F.col(text))
    if template == "1":
        return hits.withColumns({"body": trimmed, "defused": F.lit(0)})
    body, edits = G.defuse(trimmed)
    return hits.withColumns({"body": body, "defused": edits})


def packed(hits: DataFrame, budget: int, order: str = "rank", cost: str = "cost") -> DataFrame:
    """hits with kept, used (tokens up to and with this one) and n (number in the prompt, null if not kept).

    Whole passages in rank order while they fit; one that doesn't is passed over, and later ones still tried. Every
    passage but the first costs one more, for the blank line. A fold over each question's few hits."""
    one_of("order", order, ORDERS)
    lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(cost).cast("int").alias("cost")))).alias("_l"))
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.array().cast("array<struct<rank:int,used:int,nth:int>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["used"] + x["cost"] + F.when(acc["n"] > 0, 1).otherwise(0)
        one = F.struct(x["rank"].cast("int").alias("rank"), total.alias("used"), acc["n"].alias("nth"))
        more = F.struct(total.alias("used"), (acc["n"] + 1).alias("n"), F.concat(acc["kept"], F.array(one)).alias("kept"))
        return F.when(total <= budget, more).otherwise(acc)

    folded = lists.select("qid", F.aggregate("_l", state, step).alias("_s"))
    kept = folded.select("qid", F.col("_s.n").alias("_n"), F.explode("_s.kept").alias("_k")).select("qid", "_n", F.col("_k.rank").alias("rank"), F.col("_k.used").alias("used"), F.col("_k.nth").alias("_nth"))
    rows = hits.join(kept, ["qid", "rank"], "left")
    place = presentation_position(F.col("_nth"), F.col("_n"), order) + 1
    return rows.withColumns({"kept": F.col("used").isNotNull(), "n": place}).drop("_nth", "_n")


def prompt(packed_hits: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, prompt: the kept passages by number, then the question."""
    parts = packed_hits.where("kept").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("_l"))
    one = lambda x: F.concat(F.lit("["), x["n"], F.lit("] "), x["body"], F.lit("\n"))
    rows = questions.join(parts, "qid", "left")
    sources = F.array_join(F.transform(F.coalesce("_l", F.array().cast("array<struct<n:int,body:string>>")), one), "\n")
    return rows.select("qid", F.concat(F.lit("Sources:\n\n"), sources, F.lit("\nQuestion: "), F.col("question")).alias("prompt"))


def content_words(question: Column) -> Column:
    return F.array_except(F.regexp_extract_all(F.lower(question), F.lit(LEXEME), F.lit(0)), F.array(*map(F.lit, QUESTION_STOP)))


def extractive(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, answer, n, shared: the passages' sentence with the most content words of the question, the first of equals
    (by passage number, then place), and its citation; the refusal token if no sentence shares two.

    questions: qid, question. passages: qid, n, body."""
    parts = passages.select("qid", "n", F.posexplode(F.split("body", r"(?<=[.!?])\s+|\n+")).alias("at", "sentence"))
    rows = parts.join(questions.select("qid", content_words(F.col("question")).alias("_q")), "qid")
    rows = rows.withColumn("shared", F.size(F.array_intersect("_q", F.regexp_extract_all(F.lower("sentence"), F.lit(LEXEME), F.lit(0)))))
    best = ranked(rows.where(F.col("shared") >= LEAST_SHARED), ["qid"], [F.desc("shared"), F.col("n"), F.col("at")], "_r").where("_r = 1")
    out = questions.select("qid").join(best.select("qid", "n", "shared", "sentence"), "qid", "left")
    text = F.concat(F.regexp_replace(F.trim(F.col("sentence")), r"\.+$", ""), F.lit(". ["), F.col("n"), F.lit("]"))
    return out.select("qid", F.coalesce(text, F.lit(G.REFUSAL_TOKEN)).alias("answer"), "n", F.coalesce("shared", F.lit(0)).alias("shared"))


def citation_report(answers: DataFrame) -> DataFrame:
    """answers (answer, valid: array of source numbers) with cited, invalid, uncited_claims, clean and refused."""
    rows = answers.withColumn("_t", C.normalise_markers(F.col("answer"))).withColumn("_n", C.marker_numbers(F.col("_t")))
    cited, invalid = C.first_uses(F.col("_n"), F.col("valid"))
    return rows.withColumns({"cited": cited, "invalid": invalid, "uncited_claims": C.uncited_claims(F.col("_t")), "clean": C.strip_invalid(F.col("_t"), F.col("valid")), "refused": G.is_refusal(F.col("answer"))}).drop("_t", "_n")


def assembled(questions: DataFrame, hits: DataFrame, budget: int = 3000, order: str = "rank", screen: str = "drop") -> DataFrame:
    """One row a question: answer, refused, cited, invalid, packed, dropped, quarantined, and what the policy removed.

    A question without passages is refused without an answer being made."""
    looked_at = screened(hits, screen)
    used = rendered(looked_at.where(~F.col("quarantined"))).withColumn("cost", tokens_in(F.col("body")))
    laid = packed(used, budget, order)
    counts = laid.groupBy("qid").agg(F.count_if("kept").alias("packed"), F.count_if(~F.col("kept")).alias("dropped"), F.sum(F.when(F.col("kept"), F.col("defused"))).alias("defused"), F.collect_list(F.when(F.col("kept"), F.col("n"))).alias("valid"))
    apart = looked_at.groupBy("qid").agg(F.count_if("quarantined").alias("quarantined"))
    raw = extractive(questions, laid.where("kept").select("qid", "n", "body"))
    rows = raw.join(counts, "qid", "left").join(apart, "qid", "left").withColumn("valid", F.coalesce("valid", F.array().cast("array<int>")))
    text, images, links = G.answer_policy(F.col("answer"))
    rows = citation_report(rows).withColumns({"answer": text, "images_removed": images, "links_removed": links})
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("qid", "answer", "refused", "cited", "invalid", zero("packed"), zero("dropped"), zero("quarantined"), zero("defused"), "images_removed", "links_removed")


def cache_key(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `key`: the SHA-256 of a JSON object of the columns in the order of their names."""
    return rows.withColumn("key", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests found in the cache with their response, the distinct keys to be made, and hits by key."""
    found = requests.join(cache.select("key", "response_text"), "key")
    missing = requests.join(cache, "key", "left_anti").dropDuplicates(["key"])
    return found, missing, found.groupBy("key").agg(F.count("*").alias("hits"))


def laundered(sentences: DataFrame) -> DataFrame:
    """qid, laundered: some sentence has the marker, cites something, and cites no poison.

    sentences: qid, sentence, marker, poison (array of source numbers)."""
    cites = C.marker_numbers(F.col("sentence"))
    hit = F.contains(F.col("sentence"), F.col("marker")) & (F.col("marker") != "") & (F.size(cites) > 0) & ~F.arrays_overlap(cites, F.col("poison"))
    return sentences.groupBy("qid").agg(F.bool_or(hit).alias("laundered"))


def numbered(rows: DataFrame, by: str = "qid") -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("rank")))
