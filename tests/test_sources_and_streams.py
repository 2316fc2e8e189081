import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery.sources import files, tables
from gleanery.streaming.filters import DeltaFilter, filter_batch, filter_stream, policy


def test_write_once_keeps_earlier_results(spark, tmp_path):
    rows = spark.range(3)
    stem = f"file://{tmp_path}/result"
    assert [tables.write_once(rows, stem, lambda w, p: w.json(p)) for _ in range(3)] == [stem, f"{stem}-2", f"{stem}-3"]


def test_log_rows_take_defaults(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    tables.log_row(spark.createDataFrame([("r1", 200)], "request_id string, status int"), path)
    r = spark.read.schema(tables.SCHEMAS["request_log"]).parquet(path).first()
    assert (r.request_id, r.input_tokens, r.cached, r.refused) == ("r1", 0, False, None)


def test_only_loaded_partitions_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.load(spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"), path, ["k"])
    tables.load(spark.createDataFrame([(2, "b")], "k int, v string"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]


def test_manifest_golden_and_files(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    (tmp_path / "m.json").write_text(json.dumps({"documents": [{"doc_key": "A", "path": "x/f.bin", "sha256": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}, {"doc_key": "B", "path": "x/g.bin", "sha256": "0"}]}))
    m = files.manifest(spark, f"file://{tmp_path}/m.json")
    assert {r.doc_key: r.ok for r in files.checked_files(spark, f"file://{tmp_path}/*.bin", m).collect()} == {"A": True, "B": False}
    (tmp_path / "g.jsonl").write_text(json.dumps({"id": "q", "type": "factual", "question": "?", "evidence": [[{"doc": "A", "quote": "x"}, {"doc": "B", "quote": "y"}]]}) + "\n")
    assert [(r.qid, r.item, r.alternative, r.doc) for r in files.golden_quotes(files.golden(spark, f"file://{tmp_path}/g.jsonl")).collect()] == [("q", 0, 0, "A"), ("q", 0, 1, "B")]
    (tmp_path / "e.jsonl").write_text(json.dumps({"financebench_id": "f", "question": "?", "doc_name": "A", "evidence": [{"doc_name": "A", "evidence_page_num": 4}]}) + "\n")
    assert files.external(spark, f"file://{tmp_path}/e.jsonl", m).first().evidence[0].page == 5


def test_run_names(spark):
    names = spark.createDataFrame([("20260101T000000Z_a.json",), ("20260102T000000Z_abl-x.json",), ("20260103T000000Z_b-batch.json",), ("20260104T000000Z_c.json",), ("x.csv",)], "file_name string")
    assert [r.name for r in files.runs(names).collect()] == ["c", "a"]
    assert files.latest(names, r"_a\.").first().file_name == "20260101T000000Z_a.json"


def test_page_source(spark, tmp_path):
    (tmp_path / "p.html").write_text("<title>T</title><script>x</script><p>a &amp; b<p>c")
    files.register(spark)
    rows = spark.read.format("gleanery_pages").load(f"file://{tmp_path}").orderBy("block_index").collect()
    assert [(r.tag, r.text) for r in rows] == [("title", "T"), ("p", "a & b"), ("p", "c")]


def deltas_of(text, size):
    return [text[k : k + size] for k in range(0, len(text), size)]


TEXT = "See ![a big chart](http://x/y.png) and [this](https://a.b) or www.z.org/q <img src=1> then 1 < 2 ends. "


@pytest.mark.parametrize("size", [1, 3, 7, 200])
def test_filter_lets_out_the_policy_of_the_whole(size):
    own = DeltaFilter()
    out = "".join([own.feed(d) for d in deltas_of(TEXT, size)] + [own.flush()])
    assert (out, own.images, own.links) == policy(TEXT)


def test_refusal_is_held_and_later_deltas_are_errors():
    own = DeltaFilter()
    assert [own.feed(d) for d in ("INSUFF", "ICIENT_CON", "TEXT.")] == ["", "", ""] and own.flush() == ""
    with pytest.raises(ValueError):
        own.feed("late")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(r, n, "delta", d) for r in ("r1", "r2") for n, d in enumerate(deltas_of(TEXT + r, 5))]
    rows += [(r, 10_000, "end", None) for r in ("r1", "r2")]
    df = spark.createDataFrame(rows, "request_id string, seq int, kind string, delta string")
    want = sorted(tuple(x) for x in filter_batch(df).collect())
    pdf = pd.DataFrame(rows, columns=["request_id", "seq", "kind", "delta"]).sort_values("seq")
    for n in range(3):
        part = pdf.iloc[n * len(pdf) // 3 : (n + 1) * len(pdf) // 3]
        spark.createDataFrame([tuple(x) for x in part.itertuples(index=False)], df.schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = filter_stream(stream).writeStream.format("memory").queryName("filtered").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("filtered")
    text = lambda rs: {r: "".join(x[2] for x in sorted(rs) if x[0] == r) for r in ("r1", "r2")}
    assert text([tuple(x) for x in got.collect()]) == text(want)


def test_windowed_stats_on_a_stream(spark, tmp_path):
    from gleanery.streaming.events import windowed_stats

    log = spark.createDataFrame([("2024-01-01 00:10:00", 200, 1.0), ("2024-01-01 05:00:00", 500, 3.0), ("2024-01-02 00:00:00", 200, 5.0)], "ts string, status int, total_ms double").withColumn("ts", F.to_timestamp("ts"))
    log.coalesce(1).write.parquet(f"file://{tmp_path}/log")
    want = sorted(tuple(r) for r in windowed_stats(log).collect())
    q = windowed_stats(spark.readStream.schema(log.schema).parquet(f"file://{tmp_path}/log")).writeStream.format("memory").queryName("stats").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("stats").collect()) == want
