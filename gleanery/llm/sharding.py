"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of places. A row's key hashes to a place, each shard owns `vnodes` pseudorandom places, and
a row belongs to the first owner clockwise from its own place. A shard takes rows up to its capacity; rows that find it
full go on clockwise to the next owner with room. Because only *how many* rows of a place go where matters, the walk
runs on one count per place (a table of fixed size, whatever the input), and rows find their shard through their rank
within their place. So the data is read twice, narrow rows are shuffled once, and nothing grows on the driver.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_PART, packed, unpacked, written

PLACES = 1 << 14
#: Parts of a key that more than 1 in HOT_PART rows have; each is ranked by itself.
PARTS = 64


def ring_points(n_shards: int, vnodes: int, places: int = PLACES, seed: int = 0) -> list[tuple[int, int]]:
    """(place, shard), sorted by place. A shard's points depend on its own number alone, save that a taken place is
    left for the next free one; so one more shard adds points and moves none."""
    if n_shards * vnodes > places // 2:
        raise ValueError(f"{n_shards} shards of {vnodes} virtual nodes need a ring of more than {places} places")
    owner: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            place = int.from_bytes(hashlib.sha256(f"{seed}/{shard}/{v}".encode()).digest()[:8], "big") % places
            while place in owner:
                place = (place + 1) % places
            owner[place] = shard
    return sorted(owner.items())


def capacities(n_rows: int, n_shards: int, load_factor: float | None) -> list[int]:
    """None: quotas whose sum is n_rows, at most one apart. Else each shard may hold load_factor times the mean."""
    if load_factor is None:
        return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    if load_factor < 1:
        raise ValueError("load_factor is 1 or more")
    return [-int(-load_factor * n_rows // n_shards)] * n_shards


def allocate(counts: dict[int, int], points: list[tuple[int, int]], room: list[int], places: int = PLACES) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, slot of the first rank): where each run of a place's rows goes.

    Rows first knock at their own owner, in ring order; those turned away then move on together, one owner a round."""
    room, used, out = list(room), [0] * len(room), []
    at = [p for p, _ in points]
    waiting = [(place, 0, n, bisect_left(at, place) % len(points)) for place, n in sorted(counts.items()) if n]
    while waiting:
        turned_away = []
        for place, lo, hi, k in waiting:
            shard = points[k][1]
            if take := min(room[shard], hi - lo):
                out.append((place, lo, lo + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if lo + take < hi:
                turned_away.append((place, lo + take, hi, (k + 1) % len(points)))
        if turned_away and not any(room):
            raise ValueError("the shards have less room than there are rows")
        waiting = turned_away
    return out


def _hot(rows: DataFrame, column: str, total: int) -> list[int]:
    """The values that more than one row and more than 1 in HOT_PART of all rows have: fewer than HOT_PART."""
    return [r[0] for r in rows.groupBy(column).count().where((F.col("count") > 1) & (F.col("count") * HOT_PART > total)).collect()]


def _ranked(rows: DataFrame, counts: dict[int, int], ties: list[str]) -> DataFrame:
    """rows with _rank, from 0 within their _place.

    Rows go by hash, key and ties. Hot keys come after the other rows of their place, in PARTS parts by a hash of their
    ties; rows equal in these that are hot again are interchangeable and dealt at random, once, in a written table."""

    def numbered(part: DataFrame, *by: str) -> DataFrame:
        return part.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_hash", "_key", *ties)).cast("long") - 1)

    total = sum(counts.values())
    crowded = [p for p, n in counts.items() if n > 1 and n * HOT_PART > total]
    hot = _hot(rows.where(F.col("_place").isin(crowded)), "_hash", total) if crowded else []
    if not hot:
        return numbered(rows, "_place")
    own = rows.where(F.col("_hash").isin(hot)).withColumns({"_group": F.xxhash64("_hash", *ties), "_part": (F.rand() * PARTS).cast("int")})
    own = written(own, "hot_keys")
    equal = F.col("_group").isin(_hot(own, "_group", total))
    own = own.withColumn("_part", F.when(equal, F.col("_part")).otherwise(F.pmod("_group", F.lit(PARTS)).cast("int"))).withColumn("_group", F.when(equal, F.col("_group")).otherwise(0))
    keys = ["_place", "_hash", "_group", "_part"]
    sizes = own.groupBy(keys).count().collect()  # at most 2 * HOT_PART * PARTS rows
    at = dict(counts)
    for r in sizes:
        at[r["_place"]] -= r["count"]
    begins = []
    for *key, n in sorted(tuple(r) for r in sizes):
        begins.append((*key, at[key[0]]))
        at[key[0]] += n
    table = rows.sparkSession.createDataFrame(begins, "_place int, _hash long, _group long, _part int, _begin long")
    own = numbered(own, *keys).join(F.broadcast(table), keys).withColumn("_rank", F.col("_rank") + F.col("_begin"))
    return numbered(rows.where(~F.col("_hash").isin(hot)), "_place").unionByName(own.drop("_group", "_part", "_begin"))


def assign_shards(df: DataFrame, key: str, n_shards: int, *, load_factor: float | None = None, vnodes: int = 64, places: int = PLACES, seed: int = 0, tie: list[str] | None = None) -> DataFrame:
    """df with `shard` (int, 0 to n_shards - 1) and `slot` (long, gapless from 0 within the shard).

    key: column whose text decides the place on the ring; rows with a null key are placed by the columns of tie. tie:
    columns that order rows of equal keys; rows equal in all of these are interchangeable. Keys and equal rows that more
    than a thousandth of all rows have are ranked in parts, so no key is one task's. An empty df gives an empty result. Columns of df may have any names; those called shard and slot are replaced."""
    if places & (places - 1):
        raise ValueError("places is a power of 2")
    spark, tie = df.sparkSession, tie or []
    of_null = F.xxhash64(F.lit(seed), *tie) if tie else F.xxhash64(F.lit(seed), F.lit(""))
    hashed = F.when(F.col(key).isNull(), of_null).otherwise(F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    rows = packed(df, _hash=F.shiftrightunsigned(hashed, 1), _key=F.col(key), **{f"_tie{k}": F.col(c) for k, c in enumerate(tie)})
    rows = rows.withColumn("_place", F.shiftright("_hash", 63 - (places - 1).bit_length()).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("_place").count().collect()}  # at most `places` rows
    parts = allocate(counts, ring_points(n_shards, vnodes, places, seed), capacities(sum(counts.values()), n_shards, load_factor), places)
    table = spark.createDataFrame(parts or [(0, 0, 0, 0, 0)], "_at int, _lo long, _hi long, _shard int, _slot long")
    rows = _ranked(rows, counts, [f"_tie{k}" for k in range(len(tie))])
    # The table has at most one row a place and one a shard's filling up more: a fixed bound.
    found = rows.join(F.broadcast(table), (F.col("_place") == F.col("_at")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return unpacked(found, df.columns, shard=F.col("_shard"), slot=F.col("_slot") + F.col("_rank") - F.col("_lo"))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: the shards' quotas differ by one row at most, and the ring fills each to its quota. A null text
    has no bytes and the CRC of the empty text; grown_shard belongs to another law and is null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return assign_shards(narrow, "doc_id", n_shards, tie=["text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
