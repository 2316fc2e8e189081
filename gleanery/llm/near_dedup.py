"""MinHash near-dedup by a multi-index Hamming join.

Every document becomes a signature of CHUNKS * PER_CHUNK b-bit minima. Two signatures that differ in fewer than
CHUNKS * (ERRORS + 1) places agree, in some chunk, in all but ERRORS places; so each chunk is indexed once for each
choice of places left out, and all pairs under that distance share a key. (Pairs beyond it are found too, unless no
chunk is that alike: at the similarity threshold 3 in 100,000 are not.) Candidates are confirmed on their full sets.

Texts of the same words in the same order (by SHA-256) are one class from the start, and pairs are of classes. A key's
members are first held against one of them, their leader, alone: by signatures, then by their full sets. Only where this
leaves a leader's members in different components are pairs across these compared, in blocks of bounded size: by
signatures, then, for members that have a near one there, by their full sets, as products of a 0/1 matrix. A block returns
only links that join components, so neither pairs nor texts multiply, and no link is given up that would join two
components. Hashes choose candidates and nothing else: sets are counted, compared and confirmed by their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, once, small_batches, written
from .components import components
from .hashing import joined_words, mixed, word_numbers

SHINGLE, PERCENT = 5, 80
#: The words of a shingle that the registered query's contract names.
CONTRACT_SHINGLE = 2
CHUNKS, PER_CHUNK, ERRORS, BITS = 12, 7, 1, 8
PLACES = CHUNKS * PER_CHUNK
#: The signature distance up to which pairs with a common key are held against their full sets. Sets at the threshold of
#: 80 % differ in a fifth of their places, 16.8 of 84, and in more than this many with a chance of 4 in 10**12.
MOST_DIFFERENT = 46
SEED = 20240607
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return joined_words(text.encode("utf-8", "surrogatepass"), lower=True).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """One 64-bit hash for each distinct shingle. Which shingles are the same is settled by the words, not by hashes."""
    if not words:
        return np.empty(0, np.uint64)
    index = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, own = np.fromiter(map(index.__getitem__, words), np.int64, len(words)), word_numbers(list(index), SEED)
    size = min(size, len(words))
    labels, hashes = ids, own
    if size == 1:
        return own
    for k in range(1, size):
        # The label of a shingle's first k words and its next word make the label of k + 1 words.
        both = labels[: ids.size - k] * len(index) + ids[k:]
        pairs, labels = np.unique(both, return_inverse=True) if k + 1 < size else (np.unique(both), labels)
        hashes = mixed(hashes[pairs // len(index)] * _MIX + own[pairs % len(index)])
    return hashes


def shingle_set(text: str, size: int) -> set:
    """The shingles themselves."""
    found = words_of(text)
    if not found:
        return set()
    return {tuple(found)} if len(found) < size else set(zip(*(found[k:] for k in range(size)), strict=False))


class Signer:
    def __init__(self) -> None:
        random = np.random.Generator(np.random.PCG64(SEED))
        self.factors = random.integers(0, 1 << 63, (PLACES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = random.integers(0, 1 << 63, (PLACES, 1), np.uint64)

    def signature(self, hashes: np.ndarray) -> bytes:
        least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, hashes.size, 1024):
            np.minimum(least, (hashes[None, lo : lo + 1024] * self.factors + self.terms).min(axis=1), out=least)
        return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def text_key(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text. The key is the SHA-256 of the text as it stands, to find a row's text again."""
    return docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_key"), "text")


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, class_digest, signature (both null for an empty set): a row for each of docs."""

    def run(batches):
        signer = once("signer", Signer)
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(2):
                words = words_of(text.as_py()) if text.is_valid else []
                hashes = shingle_hashes(words, shingle)
                row = (hashes.size, hashlib.sha256(b" ".join(words)).digest(), signer.signature(hashes)) if words else (0, None, None)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.binary(), pa.binary()), strict=True))], names=["doc_id", "text_key", "n_shingles", "class_digest", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(text_key(docs)).mapInArrow(run, f"doc_id {kind}, text_key binary, n_shingles long, class_digest binary, signature binary")


def index_keys(signed: DataFrame) -> DataFrame:
    """id, n, key: each signature's chunks, one key for each way to leave out a place: its number, the chunk's and the
    other places' bits, so that equal keys are equal chunks but for that place."""

    def run(batches):
        keep = [[p for p in range(PER_CHUNK) if p != gone] for gone in range(PER_CHUNK)]
        shifts = (np.uint64(BITS) * np.arange(PER_CHUNK - 1, dtype=np.uint64))[None, None, :]
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                n = batch.num_rows
                places = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, CHUNKS, PER_CHUNK).astype(np.uint64)
                keys = np.empty((n, CHUNKS, PER_CHUNK), np.int64)
                for gone, own in enumerate(keep):
                    number = np.uint64(1) * np.arange(CHUNKS, dtype=np.uint64) * np.uint64(PER_CHUNK) + np.uint64(gone)
                    keys[:, :, gone] = ((places[:, :, own] << shifts).sum(axis=2) | (number << np.uint64(BITS * (PER_CHUNK - 1)))[None, :]).astype(np.int64)
                ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, PLACES)), pa.array(np.repeat(sizes, PLACES)), pa.array(keys.reshape(-1))], names=["id", "n", "key"])

    return signed.select("id", "n", "signature").mapInArrow(run, "id long, n long, key long")


def sizes_allow(m: Column, n: Column, percent: int) -> Column:
    """Sets of these sizes can be that similar."""
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def near_signatures(pairs: DataFrame, signed: DataFrame, most: int, percent: int) -> DataFrame:
    """The pairs a, b whose signatures differ in at most `most` places and whose sizes allow the similarity."""
    rows = pairs
    for x in ("a", "b"):
        rows = rows.join(signed.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"sig_{x}")), x)

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, PLACES) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a != b).sum(axis=1) <= most))

    return rows.where(sizes_allow(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough. texts: id, text."""

    def run(batches):
        last, own = None, set()
        for batch in batches:
            good = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:
                    last, own = b, shingle_set(text_b.as_py(), shingle)
                other = shingle_set(text_a.as_py(), shingle)
                both = len(own & other)
                good.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """id, text of these classes: a pass of the texts, joined by merging whatever the size, as ids grow with the documents."""
    wanted = classes.select("id", "doc_id", "text_key").join(ids.distinct(), "id", "left_semi").hint("merge")
    return written(text_key(docs).join(wanted, ["doc_id", "text_key"]).select("id", "text").dropDuplicates(["id"]), tag)


def near_links(docs: DataFrame, classes: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, most: int = MOST_DIFFERENT) -> DataFrame:
    """a, b: links that leave the components of all pairs of similar sets as they are.

    docs: doc_id, text. classes: id, n, signature, and by doc_id and text_key the row of docs that has the class's text."""
    signed = classes.select("id", "n", "signature")
    keys = index_keys(signed)
    first = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("members")).where("members > 1")
    members = written(keys.join(first, "key").select("leader", "id", "n").distinct(), "members")
    stars = near_signatures(members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")), signed, most, percent)
    stars = written(stars, "stars")
    texts = _texts(docs, classes, stars.select(F.col("a").alias("id")).union(stars.select("b")), "texts_of_stars")
    to_leader = written(confirmed(stars, texts, shingle, percent), "links_to_leaders")
    dropped(texts)
    labels = components(to_leader)
    members = written(members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "member_components")
    mixed_leaders = members.groupBy("leader").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi AND size > 2").select("leader")
    # A member alone with its leader has been held against it already.
    rest = members.join(written(mixed_leaders, "mixed_leaders"), "leader", "left_semi")
    near = written(_in_blocks(rest, signed.select("id", "signature"), 20_000, _near_members(most, percent)).select("leader", F.col("a").alias("id")).distinct(), "near_across")
    if near.isEmpty():
        return to_leader
    texts = _texts(docs, classes, near.select("id"), "texts_across")
    found = written(_in_blocks(members.join(near, ["leader", "id"], "left_semi"), texts, 2_000, _joining_links(shingle, percent)).select("a", "b").distinct(), "joining")
    across = written(confirmed(found, texts, shingle, percent), "links_across")
    dropped(texts)
    return to_leader.unionByName(across)


#: Members of a leader in one block; two blocks are compared at a time.
BLOCK = 512


def _in_blocks(members: DataFrame, contents: DataFrame, rows_at_once: int, compare) -> DataFrame:
    """leader, a, b: what compare gives for every two blocks (and each alone) of every leader's members. Many small
    groups go in one call. members: leader, id and more for compare, contents: id and the rest for it. A member of a leader
    with g blocks is sent g times."""
    members = written(members, "to_compare")
    sizes = written(members.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).where("_blocks > 1"), "blocks")
    rows = members.join(sizes, "leader", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_blocks", "_other")
    total = members.count()
    rows = rows.withColumn("_call", F.pmod(F.xxhash64("leader", "_i", "_j"), F.lit(max(1, total // rows_at_once))).cast("int")).join(contents, "id")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("leader", "ascending"), ("_i", "ascending"), ("_j", "ascending"), ("id", "ascending")])
        at = np.stack([table.column(c).to_numpy() for c in ("leader", "_i", "_j")])
        edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
        out = [(int(at[0, lo]), a, b) for lo, hi in zip(edges, edges[1:], strict=False) if hi - lo > 1 for a, b in compare(table.slice(lo, hi - lo))]
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate(("leader", "a", "b"))})

    return rows.groupBy("_call").applyInArrow(run, "leader long, a long, b long")


def _near_members(most: int, percent: int):
    """(id, id) of each member with another, of another component, whose signature and size are near."""

    def compare(table: pa.Table):
        ids, n, component = (table.column(c).to_numpy() for c in ("id", "n", "component"))
        places = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, PLACES)
        seen = np.zeros(ids.size, bool)
        names, counts = np.unique(component, return_counts=True)
        for k in np.flatnonzero(component != names[counts.argmax()]).tolist():
            # Each pair across components has an end outside the largest one.
            other = np.flatnonzero(component != component[k])
            fits = other[np.minimum(n[k], n[other]) * 100 >= np.maximum(n[k], n[other]) * percent]
            near = fits[(places[k][None, :] != places[fits]).sum(axis=1) <= most]
            if near.size:
                seen[near] = seen[k] = True
        yield from ((i, i) for i in ids[seen].tolist())

    return compare


def _set_matrix(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts with words: each one's number of distinct shingles, then text and shingle number of each of them, for
    shingles that several have."""
    words = [words_of(t) for t in texts]
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for own in words for w in own], np.int64)
    text = np.repeat(np.arange(len(words)), [len(w) for w in words])
    end = np.cumsum([len(w) for w in words])[text]
    labels, at = ids, np.arange(ids.size)
    for k in range(1, size):
        fits = at + k < end[at]
        at = at[fits]
        labels = np.unique(labels[fits] * len(index) + ids[at + k], return_inverse=True)[1].reshape(-1)
    short = [k for k, w in enumerate(words) if len(w) < size]  # one shingle each, and no other text has it
    both = np.unique(text[at] * (int(labels.max()) + 1 if labels.size else 1) + labels)
    row, column = np.divmod(both, int(labels.max()) + 1 if labels.size else 1)
    sizes = np.bincount(row, minlength=len(words))
    sizes[short] = 1
    times = np.bincount(column) if column.size else np.zeros(1, np.int64)
    many = times[column] > 1
    return sizes, row[many], (np.cumsum(times > 1) - 1)[column[many]]


def _joining_links(shingle: int, percent: int):
    """Links between members, as many as it takes to join the components that links join."""

    def compare(table: pa.Table):
        ids, own = table.column("id").to_pylist(), table.column("component").to_pylist()
        sizes, row, column = _set_matrix(table.column("text").to_pylist(), shingle)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((sizes.size, sizes.size), np.float32)
        width = 4096
        for lo in range(0, int(column[-1]) + 1 if column.size else 0, width):
            a, z = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((sizes.size, min(width, int(column[z - 1]) - lo + 1)), np.float32)
            part[row[a:z], column[a:z] - lo] = 1
            both += part @ part.T
        shared = np.rint(both).astype(np.int64)
        linked = np.triu(100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared), 1)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for a, b in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
            ra, rb = find(own[a]), find(own[b])
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                yield ids[b], ids[a]

    return compare


def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs. doc_id keeps its type, whatever that is.

    Texts without words (null ones too) have no shingles and are linked with nothing. Rows with a null doc_id are left
    unlinked, with a null component, and are kept. Rows that share a doc_id are one document: what one of them is linked
    with, all are, and n_shingles is each row's own. An empty table gives none. Only doc_id and text are read, so other
    columns may have any name. A text is held whole by one task."""
    docs = docs.select("doc_id", "text")
    base = written(sketch(docs, shingle), "sketches")
    full = base.where("doc_id IS NOT NULL AND class_digest IS NOT NULL")
    classes = full.groupBy("class_digest").agg(F.min(F.struct("doc_id", "text_key", F.col("n_shingles").alias("n"), "signature")).alias("x"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "class_digest", "x.doc_id", "x.text_key", "x.n", "x.signature"), "classes")
    links = near_links(docs, classes, shingle, percent)
    no_words = F.coalesce("class_digest", F.lit(b""))
    several = base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(no_words).alias("lo"), F.max(no_words).alias("hi")).where("lo <> hi").select("doc_id")
    several = written(several, "ids_with_several_texts")
    repeated = not several.isEmpty()
    if repeated:
        own = written(full.join(several, "doc_id", "left_semi").select("doc_id", "class_digest").distinct().join(classes.select("class_digest", "id"), "class_digest").select("doc_id", "id"), "their_classes")
        links = links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b"))
    labels = written(components(links).withColumnRenamed("node", "id").join(classes.select("id", "class_digest", "doc_id"), "id"), "class_labels")
    least = written(labels.groupBy("component").agg(F.min("doc_id").alias("component_id")), "components")
    found = written(labels.join(least, "component").select("class_digest", "component_id"), "class_components")
    alone = classes.join(found, "class_digest", "left_anti").select("class_digest", F.col("doc_id").alias("component_id"))
    rows = base.select("doc_id", "n_shingles", "class_digest").join(found.unionByName(alone), "class_digest", "left")
    if repeated:
        # A row without words has the component of the other rows of its document.
        common = rows.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("common"))
        rows = rows.join(written(common, "components_of_ids"), "doc_id", "left").withColumn("component_id", F.coalesce("common", "component_id"))
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d) UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY ALL)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""
