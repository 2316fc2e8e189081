"""WARC archives with an index written first, and reads by byte range.

Writing: each task puts its rows into one archive (a new one beyond `archive_bytes`), every record its own gzip member,
and returns offset, length, URL and digest of each; these rows are written as a table before anything is read. Reading:
index rows sorted by archive and offset, neighbouring ranges coalesced into one read each, members cut out, unzipped,
parsed, and held against their digests. An attempt of a task that is lost leaves an archive that no index row names.

The archives lie in the folder named by the caller, by default in the shared one of spark.checkpoint.dir; Python tasks
open it with pyarrow's file systems (file, S3, GCS, HDFS).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_PART, packed, shared_dir, small_batches, unpacked, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, record_type string, refers_to long, digest string, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> tuple[bytes, str]:
    """A WARC/1.1 response record, or a revisit record if refers_to is given, and the payload's digest.

    A revisit holds the HTTP header alone; its Content-Length is that of the full payload. White space in a URL is
    percent-encoded, so that it can't end the header line; a null URL has no line."""
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c <= " " else c for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse_record(record: bytes) -> dict:
    """The header fields (lower-case names), `http_length` and `payload` (None in a revisit). ValueError if damaged."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    out: dict = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    size = int(out["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    out["http_length"] = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
    out["payload"] = payload if out["warc-type"] == "response" else None
    if out["payload"] is not None and (len(payload) != out["http_length"] or f"sha1:{base32_sha1(payload)}" != out["warc-payload-digest"]):
        raise ValueError("the payload does not match its digest")
    return out


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """The written index of the archives. rows: page_id, url, html, refers_to (null: a response)."""

    def write(batches):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                record, digest = record_bytes(page_id, url, (html or "").encode(), refers_to)
                member = gzip.compress(record, 5, mtime=0)
                out.write(member)
                found.append((page_id, url, "response" if refers_to is None else "revisit", refers_to, digest, name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), INDEX_TYPES, strict=True)] if found else [pa.array([], t) for t in INDEX_TYPES], names=INDEX_NAMES)
        if out is not None:
            out.close()

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return written(small_batches(rows.select("page_id", "url", "html", "refers_to")).mapInArrow(write, INDEX), "warc_index")


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
INDEX_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]
RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]
RECORD_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]


def runs(entries: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, list[int]]]:
    """(start, end, entry numbers): sorted (offset, length) entries, those at most `gap` apart read together, up to `most` bytes."""
    out: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(entries):
        if out and offset - out[-1][1] <= gap and max(out[-1][1], offset + length) - out[-1][0] <= most:
            start, end, own = out[-1]
            out[-1] = (start, max(end, offset + length), [*own, k])
        else:
            out.append((offset, offset + length, [k]))
    return out


def read_records(index: DataFrame, folder: str, *, payloads: bool = True, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """The records that these index rows name. payloads: False leaves `payload` null after checking it."""

    def read(batches):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end]["archive"] == rows[at]["archive"]:
                    end += 1
                if rows[at]["archive"] != name:
                    if file is not None:
                        file.close()
                    name = rows[at]["archive"]
                    file = system.open_input_file(f"{path}/{name}")
                for start, stop, own in runs([(r["offset"], r["length"]) for r in rows[at:end]], gap, most):
                    data = file.read_at(stop - start, start)
                    out = []
                    for r in (rows[at + k] for k in own):
                        lo = r["offset"] - start
                        x = parse_record(zlib.decompress(data[lo : lo + r["length"]], 31))
                        if x["warc-payload-digest"] != f"sha1:{r['digest']}":
                            raise ValueError(f"the index does not match {name} at {r['offset']}")
                        number = lambda v: None if v is None or v[12:-1] == "None" else int(v[12:-1])
                        out.append((number(x["warc-record-id"]), x.get("warc-target-uri"), x["warc-type"], number(x.get("warc-refers-to")), x["http_length"], x["warc-payload-digest"][5:], x["payload"] if payloads else None))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), RECORD_TYPES, strict=True)], names=RECORD_NAMES)
                at = end
        if file is not None:
            file.close()

    ordered = index.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, RECORD)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with refers_to: of equal payloads of least_bytes or more the largest page_id is the response (null), the
    others refer to it. A null payload is empty. Rows that repeat a response's page_id are responses as well, and so are
    rows of a payload that has null page_ids only. Columns may have any names; one called refers_to is replaced.

    Groups are made of narrow rows; only groups of two or more meet the pages. Payloads of more than a thousandth of all
    pages, fewer than a thousand, are looked up in a broadcast table, and their pages are dealt by a hash of their other columns after that; so no
    payload gathers full rows in one task."""
    rows = packed(pages, html=F.coalesce("html", F.lit("")), page_id=F.col("page_id"))
    rows = rows.select("_own", "page_id", F.sha2("html", 256).alias("_key"), F.octet_length("html").alias("_bytes"), F.xxhash64(*[F.col("_own")[c] for c in pages.columns if c != "html"]).alias("_deal"))
    groups = rows.where(F.col("_bytes") >= least_bytes).groupBy("_key").agg(F.max("page_id").alias("_last"), F.count("*").alias("_times"))
    groups = written(groups.where("_times > 1"), "payload_groups")
    total = pages.count()
    hot = groups.where(F.col("_times") * HOT_PART > total).select(F.col("_key").alias("_hot_key"), F.col("_last").alias("_hot_last"))
    rows = rows.join(F.broadcast(hot), F.col("_key") == F.col("_hot_key"), "left")
    rows = rows.withColumn("_key", F.when(F.col("_hot_key").isNull(), F.col("_key")).otherwise(F.concat(F.lit("-"), F.col("_deal").cast("string"))))
    rows = rows.join(groups.where(F.col("_times") * HOT_PART <= total).select("_key", "_last"), "_key", "left")
    last = F.coalesce("_hot_last", "_last")
    return unpacked(rows, pages.columns, refers_to=F.when(~F.col("page_id").eqNullSafe(last), last))


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: as read back from the archives just written."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc"
    index = write_archives(with_revisits(pages.select("page_id", "url", "html")), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, h, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM x
"""
