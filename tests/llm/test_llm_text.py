"""Substring and near dedup, WARC, tokenizers, language ID and the pipeline against plain versions."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import exact_dedup, language_id, near_dedup, sentencepiece_codec, substring_dedup, token_counts, vocabulary, warc
from gleanery.llm.components import components
from gleanery.llm.hashing import WindowHash, mixed, word_numbers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats_brute(rows):
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - 49):
            f = first.get(tuple(w[p : p + 50]))
            if f is not None and (i is None or f < i):
                gone.update(range(p, p + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("sizes", [(1 << 22, 1 << 20), (3000, 500)])
def test_repeats(docs, rows, sizes):
    found = substring_dedup.remove_repeats(docs, *sizes)
    got = found.select("doc_id", "n_words", F.aggregate("repeats", F.lit(0).cast("long"), lambda a, x: a + x["n_words"]).alias("n"), F.sha2("kept_text", 256).alias("s")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n, r.s) for r in got) == repeats_brute(rows)
    assert any(r.n for r in got)


def test_repeats_of_an_empty_table(none):
    assert substring_dedup.repeats_removed(none).count() == 0


def test_window_hashes_are_polynomials():
    rng = random.Random(1)
    h = WindowHash(b"k" * 16)
    w = [b"%d" % rng.randrange(40) for _ in range(5000)]
    numbers = word_numbers(w, h.seed).tolist()
    want = [sum(numbers[i + j] * pow(h.base, j, 1 << 64) for j in range(25)) % (1 << 64) for i in range(len(w) - 24)]
    assert h.windows(w, 25).tolist() == mixed(np.array(want, np.uint64)).tolist()
    assert not h.windows(w[:24], 25).size and not h.windows([], 25).size


def test_clashing_window_hashes_remove_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WindowHash", lambda key: type("All", (), {"windows": lambda self, words, size: np.zeros(max(0, len(words) - size + 1), np.uint64)})())
    texts = substring_dedup.Texts(substring_dedup.pa.table({"doc_id": [1, 2], "text": [" ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))]}), b"z" * 16)
    first = substring_dedup.probe(0, texts, 0)
    second = substring_dedup.extend(0, texts, dict(zip(*(substring_dedup.answer_blocks(first).column(c).to_pylist() for c in ("bucket", "body")))), 0)
    answers = substring_dedup.answer_windows(second).to_pylist()
    sent = next((r["body"], r["extra"]) for r in answers if r["kind"] == substring_dedup.ANCHORS)
    assert second.num_rows == 2 and substring_dedup.repeats(texts, sent, {0: next(r["body"] for r in answers if r["kind"] == substring_dedup.HASHES)}, [0]) == [[], []]


def thue_morse(n, flip=0):
    """Has the same hash as its complement under any polynomial modulo a power of 2."""
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def colliding_rows():
    rng = random.Random(9)
    out = []
    for n in (1024, 2048):
        t, u = thue_morse(n), thue_morse(n, 1)
        tail, head = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "wv")
        inside = [" ".join([*head, x, *tail]) for x in (t, u)]
        out += [f"{t} {' '.join(tail)}", f"{u} {' '.join(tail)}", *inside, t, u, f"{t}\n{' '.join(head)}", f"{u}\n{' '.join(head)}", " ".join(t), " ".join(u)]
    return [(k, t) for k, t in enumerate(out)]


def test_texts_with_equal_polynomials_stay_apart(spark):
    rows = colliding_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeats_removed(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_brute(rows)
    sets, component = near_brute(rows)
    for r in near_dedup.near_groups(df, 2).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], r.doc_id == component[r.doc_id])


def test_parcels_grow_with_the_input():
    for total in (0, 10**6, 5 * 10**8, 3 * 10**10):
        group, bucket = substring_dedup.exchange_sizes(total)
        assert 4 << 20 <= group <= 64 << 20 and 1 << 20 <= bucket <= 64 << 20 and group * bucket >= 999 * total
    assert substring_dedup.exchange_sizes(10**14) == (64 << 20, 64 << 20)


def test_ids_that_are_not_numbers_are_an_error_for_repeats(spark):
    with pytest.raises(TypeError, match="doc_id"):
        substring_dedup.remove_repeats(spark.createDataFrame([("a1", "x")], "doc_id string, text string"))


def near_brute(rows, size=2):  # the contract's size
    sets = {}
    for r in rows:
        if r[0] is not None:
            w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
            sets[r[0]] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups(docs, rows, size):
    sets, component = near_brute(rows, size)
    got = near_dedup.near_groups(docs, size).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], r.doc_id == component[r.doc_id])


def test_one_id_with_several_texts_is_one_document(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    other, near = " ".join(f"o{k}" for k in range(80)), " ".join([*base[:50], "changed", *base[51:]])
    rows = [(1, other), (1, " ".join(base)), (2, near), (3, other + " end"), (4, "else " * 3), (4, None), (2, ""), (5, " "), (5, None)]
    for order in (rows, rows[::-1]):
        got = near_dedup.near_groups(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True)] * 2 + [(2, 1, False)] * 2 + [(3, 1, False)] + [(4, 4, True)] * 2 + [(5, 5, True)] * 2
        assert {r.n_shingles for r in got if r.doc_id == 2} == {96, 0}
    named = spark.createDataFrame([(f"a{i}", t) for i, t in rows], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(named).collect()} == {"a1": "a1", "a2": "a1", "a3": "a1", "a4": "a4", "a5": "a5"}


@pytest.mark.parametrize("size", [1, 2, 5])
def test_shingles_are_counted_by_their_words(size):
    rng = random.Random(size)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["x", "x y"]
    sizes, row, column = near_dedup._set_matrix(texts, size)
    sets = [near_dedup.shingle_set(t, size) for t in texts]
    assert sizes.tolist() == [len(s) for s in sets] == [near_dedup.shingle_hashes(near_dedup.words_of(t), size).size for t in texts]
    own = [set(column[row == k].tolist()) for k in range(len(texts))]
    assert all(len(own[a] & own[b]) == len(sets[a] & sets[b]) for a in range(len(texts)) for b in range(a) if min(len(x.split()) for x in (texts[a], texts[b])) >= size)


@pytest.mark.parametrize("size, edits", [(2, (8, 9, 10, 11)), (5, (4, 4, 4, 5))])
def test_recall_of_pairs_at_the_threshold(spark, size, edits):
    """Pairs of similarity 0.80 to 0.85 alone, so that no third text can join them: all but 1 in 1000 at least are found."""
    rng = random.Random(21)
    rows = []
    for k in range(1500):
        w = [f"{k}x{j}" for j in range(200)]
        v = list(w)
        for j in rng.sample(range(size - 1, 200 - size, size), rng.choice(edits)):  # each changes `size` shingles
            v[j] = f"e{k}x{j}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    close = [k for k in range(1500) for a, b in [(near_dedup.shingle_set(rows[2 * k][1], size), near_dedup.shingle_set(rows[2 * k + 1][1], size))] if 80 * len(a | b) <= 100 * len(a & b)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()}
    found = [k for k in close if got[2 * k + 1] == 2 * k]
    assert len(close) > 1000 and len(found) >= 0.999 * len(close)
    assert all(got[2 * k + 1] == 2 * k + 1 for k in set(range(1500)) - set(close))


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(200, 200 + k) for k in range(1, 60)]
    cycle = [(300 + k, 300 + (k + 1) % 25) for k in range(25)]
    edges = [*chain, *star, *star, *[(b, a) for a, b in cycle], (7, 7), (None, 8), (8, None)]
    random.Random(3).shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {n: n // 100 * 100 for n in [*range(100, 141), *range(200, 260), *range(300, 325)]}
    assert len(got) == 41 + 60 + 25
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_family_about_the_threshold_loses_no_link(spark):
    """Copies with few to many edits: many pairs near the threshold, linked only through others."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(700):
        w = list(base)
        for _ in range(rng.randrange(0, 11)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**7)}"
        rows.append((k, " ".join(w)))
    sets, component = near_brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(df, 2).collect()} == component
    assert len(set(component.values())) > 1


def test_signatures_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, near_dedup.PLACES, np.uint8)
    rows = [(0, 1, bytes(a))]
    most = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for k in range(1, 60):
        b = a.copy()
        b[rng.choice(near_dedup.PLACES, most, replace=False)] ^= 255
        rows.append((k, 1, bytes(b)))
    keys = near_dedup.index_keys(spark.createDataFrame([(i, n, bytearray(s)) for i, n, s in rows], "id long, n long, signature binary")).collect()
    own = {r.key for r in keys if r.id == 0}
    assert all(own & {r.key for r in keys if r.id == k} for k in range(1, 60))


def test_near_groups_of_an_empty_table(none):
    assert near_dedup.near_groups(none).count() == 0


PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2 x\n", "<p>same</p>"), (3, None, None), (4, "http://a/é", ""), (5, "u", "<p>größe</p>" * 500), (6, "u", "<p>same</p>")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("offset", F.lit("mine"))
    got = {r.page_id: r for r in warc.archive_round_trip(pages, f"file://{tmp_path}/w").collect()}
    for i, _, html in PAGES:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}


def test_selected_records_by_byte_range(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("refers_to", F.lit(None).cast("long"))
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(pages.coalesce(1), folder, archive_bytes=500)
    assert index.select("archive").distinct().count() > 1
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(index.where("page_id IN (2, 5)"), folder, gap=0).collect()}
    assert got == {2: PAGES[1][2], 5: PAGES[4][2]}
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").iterdir())
    assert whole.count(b"WARC/1.1\r\n") == 6


def test_damaged_records_are_errors():
    record, _ = warc.record_bytes(1, "u", b"payload", None)
    assert warc.parse_record(record)["payload"] == b"payload"
    for bad in (record[:-1], record.replace(b"payload", b"pAyload"), b"x" + record):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_ranges_are_coalesced():
    assert warc.runs([(0, 10), (10, 5), (40, 5), (1000, 5)], 30, 100) == [(0, 45, [0, 1, 2]), (1000, 1005, [3])]
    assert warc.runs([(0, 60), (60, 60)], 30, 100) == [(0, 60, [0]), (60, 120, [1])]


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(none, f"file://{tmp_path}/w").count() == 0


@pytest.fixture(scope="session")
def codec():
    return sentencepiece_codec.Codec(vocabulary.read_model())


def score_of(codec, ids, text):
    unknown = sum(1 for k in ids if k in codec.byte_ids)
    return sum(codec.scores[k] for k in ids if k not in codec.byte_ids), unknown


def as_unigram(codec):
    """The model file with this codec's scores, as a unigram model for the public library."""
    import sentencepiece

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def pack(fields):
        out = b""
        for key, value in fields:
            out += number(key << 3 | (0 if isinstance(value, int) else 5 if isinstance(value, np.float32) else 2))
            out += number(value) if isinstance(value, int) else value.tobytes() if isinstance(value, np.float32) else number(len(value)) + value
        return out

    v = codec.vocabulary
    pieces = [(1, pack([(1, p.encode()), (2, np.float32(s)), (3, k)])) for p, s, k in zip(v.pieces, v.scores, v.kinds, strict=True)]
    trainer = pack([(3, 1), (35, 1)])
    normaliser = pack([(1, b"identity"), (3, 1), (4, 0), (5, 1)])
    return sentencepiece.SentencePieceProcessor(model_proto=pack([*pieces, (2, trainer), (3, normaliser)]))


def test_encoding_is_as_good_as_the_librarys(codec, rows):
    theirs = as_unigram(codec)
    texts = [r[1] for r in rows if r[1]] + ["Hello  world\n\tx é ß😀 ", "   a", "a   "]
    for t in texts:
        mine, other = np.frombuffer(codec.encode(t), "<i4").tolist(), theirs.encode(t)
        (a, n), (b, m) = score_of(codec, mine, t), score_of(codec, other, t)
        assert n == m and a == pytest.approx(b, rel=1e-5), t[:40]
        assert codec.decode(mine) == t == theirs.decode(mine)


def test_blocks_split_as_single_cuts_do(codec):
    cuts = ["▁hello", "▁thwhtionst,", "\n", "▁▁▁", "▁日本語", "é😀é", "▁a▁"[:2], "x" * 400]
    assert codec.split_many(cuts) == [codec._packed(codec.best_split(c)) for c in cuts]


def test_encode_documents(docs, rows):
    got = sentencepiece_codec.encode_documents(docs)
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"]
    for r in got.collect():
        assert (r.piece_ids is None) == (r.text is None) and r.round_trip in ((None,) if r.text is None else (True,)) and r.n_pieces == len(r.piece_ids or [])
    back = sentencepiece_codec.decode_documents(got.drop("text"))
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(str(r[1]) for r in rows)


def test_trie_finds_its_keys_and_no_others():
    rng = random.Random(1)
    keys = {bytes(rng.randrange(1, 255) for _ in range(rng.randrange(1, 6))): k for k in range(900)}
    trie = vocabulary.build_trie(keys)

    def look(key):
        node = 0
        for b in key:
            child = trie.base[node] + b
            if child < 0 or child >= len(trie.check) or trie.check[child] != node:
                return -1
            node = child
        return trie.value[node]

    assert all(look(k) == v for k, v in keys.items())
    other = [bytes(rng.randrange(0, 256) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    assert all(look(k) == keys.get(k, -1) for k in other)


def test_token_counts(docs, rows):
    v = vocabulary.read_model()
    known = {p for p, k in zip(v.pieces, v.kinds, strict=True) if k in (1, 4)}

    def greedy(word):
        at = n = 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + 20), at, -1) if word[at:e] in known), None)
            if end is None:
                return None
            at, n = end, n + 1
        return n

    def counts(text):
        each = [greedy("▁" + w) for w in WORD.findall(text or "")]
        return len(each), sum(1 if n is None else n for n in each), each.count(None)

    got = sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown_words) for r in token_counts.count_tokens(docs.select("doc_id", "text", "n_words")).collect())
    assert got == sorted((str(r[0]), *counts(r[1])) for r in rows)


def test_automaton_pops_what_greedy_pops():
    keys = [b"a", b"ab", b"abcd", b"b", b"c", b"cde", b"d", b"bcd"]
    machine = token_counts.Automaton(keys)
    rng = random.Random(4)
    for _ in range(3000):
        w = bytes(rng.choice(b"abcde") for _ in range(rng.randrange(1, 12)))
        at = n = 0
        while at < len(w) and n >= 0:
            end = next((e for e in range(len(w), at, -1) if w[at:e] in keys), None)
            at, n = (end, n + 1) if end else (len(w), -1)
        assert machine.count(w) == n, w


def test_tokenizers_on_an_empty_table(none):
    assert sentencepiece_codec.encode_documents(none).count() == 0 and token_counts.count_tokens(none).count() == 0


def viterbi(scores, penalty):
    best = list(scores[0])
    back = []
    for row in scores[1:]:
        step, own = [], []
        for j, s in enumerate(row):
            options = [best[i] - (penalty if i != j else 0) for i in range(len(row))]
            k = max(range(len(row)), key=lambda i: options[i])
            step.append(options[k] + s)
            own.append(k)
        best = step
        back.append(own)
    return max(best)


def test_labels_are_the_best_path():
    rng = np.random.default_rng(8)
    for n in (1, 2, 30, 120):
        for scale in (0.5, 3.0, 8.0):
            s = -rng.random((n, 3)) * scale
            s[n // 2 :, 0] -= scale / 2
            got = language_id.best_labels(s.astype(np.float32), 4.0)
            value = sum(float(s[k, g]) for k, g in enumerate(got)) - 4.0 * int((np.diff(got) != 0).sum())
            assert value == pytest.approx(viterbi(s.tolist(), 4.0), abs=1e-3)


def corpus(spark):
    rng = random.Random(3)
    own = {"aa": "the of and that with house water light".split(), "bb": "der die und nicht mit haus wasser licht".split(), "ру": "и в не на что дом вода свет".split()}
    rows = [(k, " ".join(rng.choice(own[x]) for _ in range(30)), x) for k in range(150) for x in [list(own)[k % 3]]]
    return rows, own, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_documents_and_spans(spark):
    rows, own, df = corpus(spark)
    model = language_id.fit(df)
    mixed = " ".join(own["aa"] * 6 + own["bb"] * 3 + own["ру"] * 2)
    got = language_id.identify(spark.createDataFrame([(1, mixed), (2, None), (3, "12 !! 34"), (4, ""), (5, "日本"), (6, "вода")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [x.lang for x in got[0].lang_spans] == ["aa", "bb", "ру"] and got[0].lang_pred == "aa" and 0.4 < got[0].score < 0.7
    assert [r.lang_pred for r in got[1:4]] == ["und"] * 3 and got[5].lang_pred == "ру" and got[5].score == 1.0
    assert got[4].lang_pred in own and got[4].score == 0.0 and [x.lang for x in got[4].lang_spans] == ["und"]


def test_held_out_accuracy_and_flags(spark):
    import zlib

    rows, _, df = corpus(spark)
    got = {r.doc_id: r for r in language_id.predict(df).collect()}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all(got[k].held_out == (k in held) for k, _, _ in rows)
    assert sum(got[k].lang_pred == x for k, _, x in rows if k in held) / len(held) > 0.95


def test_language_of_odd_and_unlabelled_tables(docs, rows, none):
    assert len(language_id.predict(docs).collect()) == len(rows)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict(unlabelled).collect()} == {"und"}
    assert language_id.predict(none).count() == 0


def test_rare_language_is_learnt_from_a_large_table(spark):
    rng = random.Random(12)
    own = {"aa": "the of and that with house".split(), "bb": "der die und nicht mit haus".split(), "ру": "и в не на что дом".split()}
    langs = [("aa", "bb")[k % 2] for k in range(1500)] + ["ру"] * 4
    df = spark.createDataFrame([(k, " ".join(rng.choice(own[x]) for _ in range(12)), x) for k, x in enumerate(langs)], "doc_id long, text string, lang string")
    model = language_id.fit(df, 100)
    assert model.langs == sorted(own)
    got = language_id.identify(df.where("lang = 'ру'"), model, spans=False).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("ру", 1.0)}
    sample = {r["lang"]: r["count"] for r in language_id.training_sample(df, 100).groupBy("lang").count().collect()}
    assert sample["ру"] == 4 and 70 <= sum(sample.values()) <= 130


def plain_score(labeller, text):
    """Share of the language with most letters, by a plain path search over the words' scores."""
    words = WORD.findall(text or "")
    labeller.learn([w for w in dict.fromkeys(words) if w not in labeller.known])
    at = [labeller.known[w] for w in words]
    scored = [k for k in at if labeller.letters[k]]
    total = sum(int(labeller.letters[k] + labeller.foreign[k]) for k in at)
    if not total:
        return None
    if not scored:
        return 0.0
    scores = [labeller.rows[k].tolist() for k in scored]
    best, back, labels = list(scores[0]), [], range(len(scores[0]))
    for row in scores[1:]:
        came = [max(labels, key=lambda i: best[i] - language_id.SWITCH_PENALTY * (i != j)) for j in labels]
        best = [best[i] - language_id.SWITCH_PENALTY * (i != j) + row[j] for j, i in enumerate(came)]
        back.append(came)
    j = max(labels, key=best.__getitem__)
    path = [j]
    for came in back[::-1]:
        j = came[j]
        path.append(j)
    share = [0] * len(best)
    for k, j in zip(scored, path[::-1], strict=True):
        share[j] += int(labeller.letters[k])
    return max(share) / total


def test_pipeline_against_a_plain_version(spark, rows, tmp_path):
    import corpus_pipeline
    from test_llm_native import exact_brute, mixed_brute

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    labeller = language_id.Labeller(model)
    scores = [plain_score(labeller, r[1]) for r in rows]
    for r in language_id.identify(docs, model, spans=False).collect():
        assert r.score == pytest.approx(plain_score(labeller, r.text) or 0.0) and (r.lang_pred == "und") == (plain_score(labeller, r.text) is None)
    left = [r for r, s in zip(rows, scores, strict=True) if s is not None and s >= corpus_pipeline.LEAST_SHARE]
    kept = {(i, sha) for i, _, _, first, sha in exact_brute(left) if first}
    found = []
    for r in left:
        key = (str(r[0]), hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]).encode()).hexdigest())
        if key in kept:
            kept.discard(key)
            found.append(r)
    _, component = near_brute(found, 5)
    found = [r for r in found if r[0] is None or component[r[0]] == r[0]]
    assert len(rows) > len(left) > len(found) > 10
    want = sorted((str(found[k][0]), str(found[k][3]), t) for k, t in mixed_brute([(r[0], r[1], r[3]) for r in found]))
    codec = sentencepiece_codec.Codec(vocabulary.read_model())
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted((str(r.doc_id), str(r.source), codec.decode(r.piece_ids)) for r in got) == want


def test_pipeline_of_an_empty_table_and_of_a_very_long_text(spark, none, tmp_path):
    import corpus_pipeline

    documents = none.drop("kept", "shard", "score", "size", "n_words")
    documents.write.parquet(f"file://{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/a").count() == 0
    rng = random.Random(17)
    text = " ".join(f"word{rng.randrange(10**6)}" for _ in range(400_000))  # over 4 MB
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([text, text + " ", "x" * 3_000_000, "some short text here"])]
    spark.createDataFrame(rows, documents.schema).write.parquet(f"file://{tmp_path}/b/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}/b").collect()}
    codec = sentencepiece_codec.Codec(vocabulary.read_model())
    assert set(got) == {0, 2, 3} and all(codec.decode(got[k].piece_ids) == rows[k][1] for k in got)


def test_operators_on_a_very_long_text(spark):
    from gleanery.llm import quality

    rng = random.Random(18)
    text = " ".join(f"word{rng.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, text), (2, text), (3, "y" * 2_000_000), (4, "a\n" * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.n_removed) for r in substring_dedup.repeats_removed(df).orderBy("doc_id").collect()] == [(1, 0), (2, 300_000), (3, 0), (4, 0)]
    assert [r.component_id for r in near_dedup.near_groups(df).orderBy("doc_id").collect()] == [1, 1, 3, 4]
    assert [r.keep_id for r in exact_dedup.exact_groups(df).orderBy("doc_id").collect()] == [1, 1, 3, 4]
    assert [r.n_words for r in quality.quality_rows(df).orderBy("doc_id").collect()] == [300_000, 300_000, 1, 500_000]
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert [(r.record_type, r.payload_bytes) for r in warc.archive_round_trip(pages).orderBy("page_id").collect()] == [("revisit", len(text)), ("response", len(text)), ("response", 2_000_000), ("response", 1_000_000)]


def test_archive_of_null_and_repeated_page_ids_and_large_records(spark, tmp_path):
    rng = random.Random(19)
    large = "".join(chr(rng.randrange(33, 1000)) for _ in range(9 << 20))  # more than one read's bytes
    rows = [(None, "u", "same"), (1, "u", "same"), (1, "u", "same"), (None, "u", "alone"), (2, "u", "other"), (2, "v", "same"), (3, None, large), (4, None, None), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.archive_round_trip(pages, f"file://{tmp_path}/w").collect()))
    assert got == sorted([("None", 4, "revisit", "2"), ("1", 4, "revisit", "2"), ("1", 4, "revisit", "2"), ("None", 5, "response", "None"), ("2", 5, "response", "None"), ("2", 4, "response", "None"), ("3", len(large.encode()), "response", "None"), ("4", 0, "response", "None"), ("None", 0, "revisit", "4")])


def test_a_payload_that_half_of_all_pages_have(spark, tmp_path):
    pages = spark.range(2400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 6 == 1, "cold").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("html"))
    got = {r.page_id: r.refers_to for r in warc.archive_round_trip(pages, f"file://{tmp_path}/w").collect()}
    last = max(k for k in range(2400) if k % 6 == 1)
    assert got == {k: (2398 if k < 2398 else None) if k % 2 == 0 else (last if k < last else None) if k % 6 == 1 else None for k in range(2400)}
