"""Mixing sources to target weights, by blocks.

The tokens of a source, its documents laid end to end in a pseudorandom order, are packed into blocks of a fixed length.
The slots of all output shards draw their sources at random, so that a shard's counts are a multinomial draw, given that
the counts of all shards add up to the sources' targets; a source's slots go through a pseudorandom permutation of its
block numbers, round after round; blocks are joined by number.

Only DataFrame functions are used. A document's place in its source's stream is a sum over fixed hash ranges of the
source plus a running sum within its range, so a source that holds a third of all rows is spread over many tasks; its
slots are dealt in runs of CHUNK. Windows without a key see one row a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, words, written

BLOCK_WORDS = 64
CHUNK, CHUNKS_OF_TASK, MOST_TASKS = 1 << 14, 16, 20_000
SLOTS_PER_SHARD = 4096
RANGES = 512
ROUNDS = 16
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> source_no, weight, target as well. One row a source goes in and out.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. The targets share the sum of all sizes by weight,
    none above most_repeats times its size; what is cut off goes to the others by weight. That is min(limit, rate *
    weight), where the rate is the same for all: with sources sorted by limit per weight, the first n are cut and the
    rest share what is left, for the one n that is consistent."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("source_no", F.row_number().over(order) - 1).withColumn("weight", F.col("source_no") % 3 + 1)
    rows = rows.withColumn("limit", F.col("source_size") * most_repeats)
    by_rate = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_rate.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("rate", (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(onwards))
    # The rate holds from the first source that it does not lift above its limit.
    rows = rows.withColumn("rate", F.min(F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("source_no"), F.col("rate").alias("rate")))).over(everything)["rate"])
    return rows.withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce("rate", F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "source_no", "weight", "target")


def shuffled_index(rows: DataFrame, index: str, size: str, keys: list[str], seed: int, rounds: int = ROUNDS) -> DataFrame:
    """rows with `index` (0 to size - 1) replaced through a pseudorandom permutation of that range, one for each value of keys.

    Each round either leaves a number or swaps it with its mirror image about a pseudorandom centre; both numbers of a
    couple read the same pseudorandom bit, so a round, and all of them, is a bijection for any size."""
    for r in range(rounds):
        centre = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), *keys), F.col(size))
        rows = rows.withColumn("_mirror", F.pmod(centre - F.col(index), F.col(size)))
        bit = F.xxhash64(F.lit(seed + 1), F.lit(r), *keys, F.greatest(F.col("_mirror"), F.col(index))).bitwiseAND(F.lit(1))
        rows = rows.withColumn(index, F.when(bit == 1, F.col("_mirror")).otherwise(F.col(index)))
    return rows.drop("_mirror")


def draw_slots(sources: DataFrame, slots_per_shard: int, seed: int) -> DataFrame:
    """source_no, n_blocks, turn, shard: a row for each slot that a source gets in an output shard.

    sources: source_no, n_blocks, rate (times that the source is to be taken). A source gets the whole number of slots
    nearest to n_blocks * rate; its turns, 0 to that number less one, take their slots by a pseudorandom permutation of
    all slots of all shards. That is the multinomial draw of every shard's counts under the condition that each source's
    counts add up to its number: drawn freely, they would miss it by the root of it."""
    rows = sources.where("n_blocks > 0").withColumn("_own", F.round(F.col("n_blocks") * F.col("rate")).cast("long")).where("_own > 0")
    rows = rows.withColumns({"_slots": F.sum("_own").over(Window.partitionBy()), "_lo": F.sum("_own").over(Window.orderBy("source_no")) - F.col("_own")})
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_own") - 1) / CHUNK))))
    rows = written(rows, "slot_chunks")
    # A few rows become all slots. The number is given, or adaptive execution would leave them to one task.
    rows = rows.repartition(max(1, min(MOST_TASKS, -(-rows.count() // CHUNKS_OF_TASK))))
    turns = F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("_own"), (F.col("_chunk") + 1) * CHUNK) - 1)
    rows = rows.select("source_no", "n_blocks", "_slots", "_lo", F.explode(turns).alias("turn")).withColumn("_slot", F.col("_lo") + F.col("turn"))
    rows = shuffled_index(rows, "_slot", "_slots", [], seed + 2)
    return rows.select("source_no", "n_blocks", "turn", F.floor(F.col("_slot") / slots_per_shard).alias("shard"))


def lay_out(docs: DataFrame, seed: int = 0, ranges: int = RANGES, text_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents on their sources' token streams, and the sources.

    First: doc_id, size, source, source_no, start (tokens of the source before this document), row_key (of the place) and
    text_key (the text's SHA-256, if asked for). Second: source, source_size, source_no, weight, target. Rows that differ
    in nothing else take places in any order."""
    key = F.unhex(F.sha2("text", 256)) if text_key else F.lit(None).cast("binary")
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("text_key"))
    sized = sized.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "size"))
    sized = written(sized.withColumn("_range", F.pmod("_hash", F.lit(ranges)).cast("int")), "sizes")
    parts = sized.groupBy("source", "_range").agg(F.sum("size").alias("_in_range"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_in_range").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    sources = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    parts = written(parts.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source"))).select("_source", F.col("_range").alias("_part"), "_before", "source_no"), "ranges")
    within = Window.partitionBy("source", "_range").orderBy("_hash", "doc_id", "size", "text_key")
    placed = sized.withColumns({"_sum": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), "_nth": F.row_number().over(within)})
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_part")))
    start = F.col("_before") + F.coalesce("_sum", F.lit(0).cast("long"))
    return placed.select("doc_id", "size", "source", "source_no", start.alias("start"), F.struct("source_no", "_range", "_nth").alias("row_key"), "text_key"), sources


def mixed_blocks(sources: DataFrame, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 0, in_arcs: bool = False) -> DataFrame:
    """source_no, block, shard, turn: the mix, one row for each slot. A block comes as often as the blocks of its source do
    on average, rounded down or up, so not more often than a document may.

    in_arcs: the permutation only turns the block numbers about by a pseudorandom amount, so that a part of a round is a
    part of the stream without gaps. The documents lie on that in a pseudorandom order already."""
    rows = sources.select("source_no", F.ceil(F.col("source_size") / block_words).alias("n_blocks"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    slots = draw_slots(rows, slots_per_shard, seed)
    slots = slots.withColumns({"_round": F.floor(F.col("turn") / F.col("n_blocks")), "block": F.col("turn") % F.col("n_blocks")})
    if in_arcs:
        slots = slots.withColumn("block", F.pmod(F.col("block") + F.pmod(F.xxhash64(F.lit(seed), "source_no"), F.col("n_blocks")), F.col("n_blocks")))
    else:
        slots = shuffled_index(slots, "block", "n_blocks", ["source_no", "_round"], seed)
    # Written, as a filter on `block` pushed down through the rounds would grow without bound.
    return written(slots.select("source_no", "block", "shard", "turn"), "mix")


def _pieces(placed: DataFrame, blocks: DataFrame, block_words: int) -> DataFrame:
    """placed with a row for each block that a document has a part in: block, _lo and _hi (words of the source before the
    part, and up to its end), times (that the mix takes the block). A document without words has an empty part."""
    times = blocks.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    first, final = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / block_words)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, final)))
    pieces = pieces.withColumns({"_lo": F.greatest(F.col("start"), F.col("block") * block_words), "_hi": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)})
    return pieces.join(times, ["source_no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 0, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: one row for each row of docs.

    size: words of the text (null: 0). target: words that the mix shall take from the whole source. taken: words of this
    document in the blocks that the mix takes, repeats counted; at most MOST_REPEATS times its size. Reruns agree. Null
    doc_ids and sources are values like any other; rows that are equal in doc_id, size and source take places in any
    order; an empty table gives none; only doc_id, source and text are read."""
    placed, sources = lay_out(docs, seed, ranges)
    pieces = _pieces(placed, mixed_blocks(sources, block_words, slots_per_shard, seed), block_words)
    taken = pieces.groupBy("row_key", "doc_id", "size", "source", "source_no").agg(F.sum((F.col("_hi") - F.col("_lo")) * F.col("times")).alias("taken"))
    sums = sources.select("source_no", "source_size", "target")
    return taken.join(sums, "source_no").select("doc_id", "size", "source", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 0, ranges: int = RANGES) -> DataFrame:
    """docs as the mix takes them: the same columns, a row for each run of a document's words in blocks of the mix, and as
    often as the mix takes these. The words of a source come to its target but for half a block.

    Parts of rounds are arcs of the source's stream, so that documents are whole, up to MOST_REPEATS times, but for the two
    that an arc's ends cut in each source: of these the words inside stay, joined by blanks. Documents without words aren't
    taken, nor are null texts. Null doc_ids and sources are values like any other; rows alike in doc_id, source and text
    each have their place, and one's other columns stand for all; an empty table gives none; other columns are carried
    along, whatever their names."""
    placed, sources = lay_out(docs, seed, ranges, text_key=True)
    placed = written(placed.where("size > 0"), "placed")
    pieces = _pieces(placed, mixed_blocks(sources, block_words, slots_per_shard, seed, in_arcs=True), block_words)
    parts = F.sort_array(F.collect_list(F.when(F.col("times") > 0, F.struct((F.col("_lo") - F.col("start")).cast("int").alias("lo"), (F.col("_hi") - F.col("start")).cast("int").alias("hi"), "times"))))
    found = pieces.groupBy("row_key").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "text_key", "size")], parts.alias("_parts")).where(F.size("_parts") > 0)
    none = F.array().cast("array<struct<lo:int,hi:int>>")

    def runs(level: int):
        def step(acc, x):
            last = F.element_at(acc, -1)
            joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), x["hi"].alias("hi"))))
            return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["hi"] == x["lo"]), joined).otherwise(F.concat(acc, F.array(F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))))

        return F.aggregate(F.filter("_parts", lambda x: x["times"] >= level), none, step)

    found = found.withColumn("run", F.explode(F.concat(*[runs(level) for level in range(1, MOST_REPEATS + 1)])))
    key, run = fresh(docs, "_text_key"), fresh(docs, "_run")
    rows = docs.withColumn(key, F.unhex(F.sha2("text", 256)))
    same = lambda other: rows["doc_id"].eqNullSafe(other[run]["doc_id"]) & rows["source"].eqNullSafe(other[run]["source"]) & (rows[key] == other[run]["text_key"])
    alike = written(placed.groupBy("doc_id", "source", "text_key").count().where("count > 1").select(F.struct("doc_id", "source", "text_key").alias(run)), "alike")
    if not alike.isEmpty():
        whole = rows
        rows = whole.join(alike, same(alike), "left_anti").unionByName(whole.join(alike, same(alike), "left_semi").dropDuplicates(["doc_id", "source", key]))
    found = found.select(F.struct("doc_id", "source", "text_key", "size", "run.lo", "run.hi").alias(run))
    part = F.col(run)
    text = F.when((part["lo"] == 0) & (part["hi"] == part["size"]), F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), part["lo"] + 1, part["hi"] - part["lo"]), " "))
    out = rows.join(found, same(found))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
