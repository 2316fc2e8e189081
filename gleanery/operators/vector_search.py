"""Nearest neighbours for batches of query vectors: exact, filtered before or after, by inverted lists, by sign bits.

Queries are sent in blocks of a bounded size, each in one pass of the vectors, which stay where they are: blocks of vectors
are multiplied with the block of queries in numpy, and k rows for each query and task are kept before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, inner_product, l2_distance
from ..sources.stored import written
from .ranking import SCORE_DIGITS, best_rows, top_k

#: Query vectors sent to the executors at once, in numbers; scores that a task makes at once; rows that it keeps, k a query.
MOST_QUERY_NUMBERS, MOST_SCORES, MOST_KEPT = 4_000_000, 1_000_000, 1_000_000


def query_blocks(queries: DataFrame, most: int = MOST_QUERY_NUMBERS, k: int = 1) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of query ids and their matrix, of at most `most` numbers each, and of as many queries as a task can keep k rows
    of, in the order of the ids: none is left out, and the driver holds one block. queries: qid, qvec."""
    ids: list = []
    vectors: list = []
    # One partition, so that the driver's iterator is one job; the task sorts it, on disk if need be.
    for qid, vector in queries.select("qid", "qvec").repartition(1).sortWithinPartitions("qid").toLocalIterator():
        if vectors and len(vectors[0]) != len(vector):
            raise ValueError("vectors of different dimensions")
        ids.append(qid)
        vectors.append(vector)
        if (len(vectors) + 1) * len(vector) > most or (len(vectors) + 1) * k > MOST_KEPT:
            yield ids, np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, np.float64)


def matrix_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of an Arrow column's vectors are not null, and these as a matrix, without a Python object for any number."""
    good = np.asarray(column.is_valid())
    kept = column.filter(pa.array(good)) if not good.all() else column
    if len(kept) and set(np.unique(np.asarray(kept.value_lengths())).tolist()) != {width}:
        raise ValueError("vectors of different dimensions")
    return good, np.asarray(kept.flatten(), np.float64).reshape(-1, width)


def _cosine(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return (q @ block.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(block, axis=1)[None, :])


def _l2(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((block - row) ** 2).sum(axis=1)) for row in q])


def _sign_distance(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Components of different sign: the Hamming distance of the sign bits, as one product."""
    a, b = (q > 0).astype(np.float32), (block > 0).astype(np.float32)
    return (a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.float64)


#: What is measured, whether the least is best, and the same as an expression.
METRICS: dict[str, tuple[Callable, bool, Callable | None]] = {
    "cosine": (_cosine, False, cosine), "inner_product": (lambda q, block: q @ block.T, False, inner_product), "l2": (_l2, True, l2_distance), "signs": (_sign_distance, True, None),
}


def _nearest(vectors: DataFrame, qids: list, matrix: np.ndarray, k: int, id: str, vector: str, metric: str, qid_type, probes: np.ndarray | None = None) -> DataFrame:
    """qid, id, score, rank. probes: whether a query (row) looks at the vectors of a list (column); without, at all."""
    shipped = vectors.sparkSession.sparkContext.broadcast((pa.array(qids, _ARROW[qid_type]), matrix, probes))
    measure, ascending, _ = METRICS[metric]
    sign = 1.0 if ascending else -1.0

    def score(batches):
        names, q, probes = shipped.value
        query, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        worst = np.full(len(q), np.inf)  # of each query the k-th best so far, the less the better
        found: list[tuple] = []  # rows that may be among the best: they are sorted once they are as many as those kept
        waiting = 0

        def merge():
            nonlocal query, ids, scores, found, waiting
            query, ids, scores = best_rows(*(np.concatenate([kept, *new]) for kept, new in zip((query, ids, scores), zip(*found, strict=True), strict=True)), k, sign)
            counts = np.bincount(query, minlength=len(q))
            full = np.flatnonzero(counts == k)
            worst[full] = sign * np.round(scores[np.cumsum(counts)[full] - 1], SCORE_DIGITS)
            found, waiting = [], 0

        every = np.arange(len(q))
        for batch in batches:
            good, block = matrix_of(batch.column(1), q.shape[1])
            own = batch.column(0).to_numpy(zero_copy_only=False)[good]
            if probes is None:
                groups = [(block, own, every)]
            else:
                lists = batch.column(2).to_numpy()[good]
                groups = [(block[lists == j], own[lists == j], np.flatnonzero(probes[:, j])) for j in np.unique(lists).tolist()]
            for some, some_ids, asking in groups:
                step = max(1, MOST_SCORES // max(1, asking.size))
                for lo in range(0, len(some) if asking.size else 0, step):
                    value = measure(q[asking], some[lo : lo + step])
                    at, row = np.nonzero(sign * value <= worst[asking][:, None] + 1e-8)  # never true of not-a-number
                    if at.size:
                        found.append((asking[at], some_ids[lo + row], value[at, row]))
                        waiting += at.size
                    if waiting > max(MOST_SCORES // 4, query.size // 2):
                        merge()
        if found:
            merge()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(ids.astype(np.int64)), pa.array(scores)], names=["qid", "id", "score"])

    columns = [F.col(id).cast("long").alias("id"), vector, *(["list"] if probes is not None else [])]
    found = vectors.select(*columns).mapInArrow(score, f"qid {qid_type}, id long, score double")
    return top_k(found, k, ascending=ascending).select("qid", "id", "score", "rank")


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, *, id: str = "vec_id", vector: str = "embedding", metric: str = "cosine", most: int = MOST_QUERY_NUMBERS) -> DataFrame:
    """qid, id, score, rank: the k nearest rows of vectors for each query. Filter vectors first to search among some.

    metric: cosine similarity, inner_product, or l2 and signs (distances: the least is best). More queries than fit into
    `most` numbers, or than a task can keep k rows of, are taken in blocks, a pass of the vectors each. Null vectors and those without length are never near;
    vectors of different dimensions are an error."""
    kind = queries.schema["qid"].dataType.simpleString()
    out = None
    for qids, matrix in query_blocks(queries, most, k):
        rows = _nearest(vectors, qids, matrix, k, id, vector, metric, kind)
        out = rows if out is None else out.unionByName(rows)
    return vectors.sparkSession.createDataFrame([], f"qid {kind}, id long, score double, rank int") if out is None else out


def rescored(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows found, which are few for each query, ordered anew by the metric as an expression, k of them."""
    pairs = found.select("qid", "id").join(vectors.select(F.col(id).alias("id"), F.col(vector).alias("_v")), "id").join(queries.select("qid", "qvec"), "qid")
    return top_k(pairs.withColumn("score", METRICS[metric][2](F.col("qvec"), F.col("_v"))).where("score IS NOT NULL"), k, ascending=METRICS[metric][1]).select("qid", "id", "score", "rank")


def by_expression(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """exact_top_k with scores by expression, in double precision whatever the vectors' type."""
    return rescored(exact_top_k(queries, vectors, k, id=id, vector=vector, metric=metric), queries, vectors, k, metric, id=id, vector=vector)


def binary_top_k(queries: DataFrame, vectors: DataFrame, k: int, candidates: int = 40, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The `candidates` nearest by sign bits (ties by id), ordered anew by cosine, k of them."""
    return rescored(exact_top_k(queries, vectors, candidates, id=id, vector=vector, metric="signs"), queries, vectors, k, id=id, vector=vector)


def post_filtered_top_k(queries: DataFrame, vectors: DataFrame, k: int, candidates: int, keep: Column, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The `candidates` nearest of all, then those that pass `keep`, k at most: fewer than k if few of them pass."""
    near = exact_top_k(queries, vectors, candidates, id=id, vector=vector).select("qid", "id", "score")
    return top_k(near.join(vectors.where(keep).select(F.col(id).alias("id")), "id", "left_semi"), k).select("qid", "id", "score", "rank")


def centroids(vectors: DataFrame, lists: int, *, vector: str = "embedding", id: str = "vec_id", sample_rows: int = 20_000, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """k-means centres of a sample of at most about sample_rows rows, chosen by a hash of the id."""
    n = vectors.count()
    some = vectors.where(F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_rows / max(1, n)))).where(F.col(vector).isNotNull()).select(id, vector).orderBy(id).limit(2 * sample_rows).collect()
    data = np.array([r[1] for r in some], np.float64)
    data /= np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-12)
    centre = data[np.random.default_rng(seed).choice(len(data), min(lists, len(data)), replace=False)]
    for _ in range(rounds):
        own = (data @ centre.T).argmax(axis=1)
        for j in range(len(centre)):
            if (own == j).any():
                mean = data[own == j].mean(axis=0)
                centre[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return centre


def inverted_lists(vectors: DataFrame, centre: np.ndarray, *, vector: str = "embedding") -> DataFrame:
    """vectors with `list`, the number of the nearest centre: every row that has a vector is indexed."""
    shipped = vectors.sparkSession.sparkContext.broadcast(centre)
    names = vectors.columns

    def assign(batches):
        for batch in batches:
            good, block = matrix_of(batch.column(names.index(vector)), shipped.value.shape[1])
            own = (block @ shipped.value.T).argmax(axis=1) if len(block) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(good)).columns, pa.array(own.astype(np.int32))], names=[*names, "list"])

    return vectors.mapInArrow(assign, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields), "list int"]))


def build_lists(vectors: DataFrame, folder: str, lists: int, *, vector: str = "embedding", id: str = "vec_id") -> None:
    """The stored index: centres, and every vector in the partition of its list, so that a probe reads its lists alone."""
    centre = centroids(vectors, lists, vector=vector, id=id)
    vectors.sparkSession.createDataFrame([(j, [float(x) for x in row]) for j, row in enumerate(centre)], "list int, centre array<double>").write.mode("overwrite").parquet(f"{folder}/centres")
    rows = inverted_lists(vectors, centre, vector=vector)
    rows.repartition("list", F.pmod(F.xxhash64(id), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists")


def stored_lists(spark, folder: str) -> tuple[DataFrame, np.ndarray]:
    """The stored vectors with `list`, and the centres."""
    centre = np.array([r.centre for r in spark.read.parquet(f"{folder}/centres").orderBy("list").collect()], np.float64)
    return spark.read.parquet(f"{folder}/lists"), centre


def _probe(near: np.ndarray, lists: int, indexed: DataFrame, qids: list, matrix: np.ndarray, k: int, kind: str, id: str, vector: str) -> DataFrame:
    """qid, id, score, rank of the k nearest vectors in the lists that each query probes. near: a query's lists, in its row."""
    probes = np.zeros((len(qids), lists), bool)
    np.put_along_axis(probes, near, True, axis=1)
    own = indexed.where(F.col("list").isin(np.flatnonzero(probes.any(axis=0)).tolist()))
    return _nearest(own, qids, matrix, k, id, vector, "cosine", kind, probes)


def probed_top_k(queries: DataFrame, indexed: DataFrame, centre: np.ndarray, k: int, probes: int, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate top k: each query looks at its `probes` nearest lists only."""
    kind, out = queries.schema["qid"].dataType.simpleString(), None
    for qids, matrix in query_blocks(queries, k=k):
        near = np.argsort(-(matrix @ centre.T), axis=1)[:, :probes]
        rows = _probe(near, len(centre), indexed, qids, matrix, k, kind, id, vector)
        out = rows if out is None else out.unionByName(rows)
    return indexed.sparkSession.createDataFrame([], f"qid {kind}, id long, score double, rank int") if out is None else out


def iterative_top_k(queries: DataFrame, indexed: DataFrame, centre: np.ndarray, k: int, probes: int, keep: Column, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate top k among the rows that pass `keep`: a query goes on to its next `probes` nearest lists, and twice as
    many each round, until k rows passed or all lists are read. What a round found is written, and counted a query."""
    kind, out = queries.schema["qid"].dataType.simpleString(), []
    passing = indexed.where(keep)
    for qids, matrix in query_blocks(queries, k=k):
        near = np.argsort(-(matrix @ centre.T), axis=1)
        done, step, rounds, open_ = 0, probes, [], set(range(len(qids)))
        while open_ and done < len(centre):
            asking = sorted(open_)
            rounds.append(written(_probe(near[asking, done : done + step], len(centre), passing, [qids[q] for q in asking], matrix[asking], k, kind, id, vector).select("qid", "id", "score")))
            every = rounds[0]
            for x in rounds[1:]:
                every = every.unionByName(x)
            full = {r.qid for r in every.groupBy("qid").count().where(F.col("count") >= k).select("qid").collect()}  # at most a block's ids
            open_ = {q for q in open_ if qids[q] not in full}
            done, step = done + step, step * 2
        out.append(top_k(every, k).select("qid", "id", "score", "rank"))
    if not out:
        return indexed.sparkSession.createDataFrame([], f"qid {kind}, id long, score double, rank int")
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def half_precision(vector: Column) -> Column:
    """Components rounded to 11 significant bits, as 16-bit floats hold them."""
    def half(x: Column) -> Column:
        x = x.cast("double")
        unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14).cast("long")) - 10)
        return F.when(x == 0, 0.0).otherwise(F.bround(x / unit, 0) * unit)

    return F.transform(vector, half)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """qid, recall: the share of each query's exact ids that were found; queries without any are left out."""
    own = exact.groupBy("qid").agg(F.collect_set("id").alias("_exact"))
    got = found.groupBy("qid").agg(F.collect_set("id").alias("_found"))
    share = F.size(F.array_intersect("_exact", F.coalesce("_found", F.array().cast("array<bigint>")))) / F.size("_exact")
    return own.join(got, "qid", "left").select("qid", share.alias("recall"))
