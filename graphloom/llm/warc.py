"""Operator 10: WARC archives, written index first and read back by coalesced byte ranges.

Each task streams its pages into one archive of gzip members (one record each) in a folder that all
executors share, and yields an index row per record: file, offset, length, URL and digest. The index
is kept as a table before anything is read. Reading takes any selection of index rows, deals them
by file and stretch of file, sorts them by offset and joins neighbours into single reads.

A task attempt writes under a name of its own and its index rows carry that name, so a repeated
attempt never mixes with a lost one.

Defined cases: null html is an empty payload; payloads under min_bytes are always responses; a null
url is written as an empty target; of repeated rows of a page_id with one payload, all are responses
when it is the smallest id (a page never revisits itself); a null page_id revisits when a page with
an id has the payload, else it is a response. Empty tables give no archive and no rows.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut, shared_dir

GAP, READ = 1 << 16, 8 << 20
#: Bytes of archive that one reading task takes.
STRETCH = 32 << 20
INDEX = "file string, offset long, length long, page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def decide(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to; the smallest page_id of a payload is the response."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.select("page_id", "url", "payload", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    firsts = p.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return p.join(firsts, "digest", "left").select("page_id", "url", "payload", "payload_bytes", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit has headers in place of the payload."""
    revisit = refers_to is not None
    body = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record and its payload; for a revisit the payload is empty."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Write archives into folder; the index, kept in the shared folder."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    store, path = _fs(name)
                    store.create_dir(os.path.dirname(path), recursive=True)
                    out = store.open_output_stream(path, compression=None)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])) + z.flush()
                out.write(data)
                rows.append({"file": name, "offset": at, "length": len(data), "page_id": r["page_id"], "url": r["url"], "digest": r["digest"], "payload_bytes": r["payload_bytes"], "record_type": "response" if r["refers_to"] is None else "revisit", "refers_to": r["refers_to"]})
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
        if out is not None:
            out.close()

    return cut(decided.mapInArrow(archive, INDEX))


SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def ranges(spans: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[list[int]]:
    """Positions of sorted (offset, length) spans, in runs that one read covers."""
    runs: list[list[int]] = []
    end = start = 0
    for i, (at, n) in enumerate(spans):
        if runs and at - end <= gap and at + n - start <= most:
            runs[-1].append(i)
            end = max(end, at + n)
        else:
            runs.append([i])
            start, end = at, at + n
    return runs


def read(index: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the selected index rows, re-measured; with payload also their bytes (null for revisits)."""

    def fetch(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["file", "offset", "length"]).to_pylist(), key=lambda r: r["offset"])
        store, path = _fs(rows[0]["file"])
        out = []
        with store.open_input_file(path) as f:
            for run in ranges([(r["offset"], r["length"]) for r in rows]):
                first = rows[run[0]]["offset"]
                f.seek(first)
                data = f.read(max(rows[i]["offset"] + rows[i]["length"] for i in run) - first)
                for i in run:
                    at = rows[i]["offset"] - first
                    head, body = parse(zlib.decompress(data[at : at + rows[i]["length"]], 31))
                    whole = head["WARC-Type"] == "response"
                    digest, n = (hashlib.sha256(body).hexdigest(), len(body)) if whole else (head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"]))
                    if f"sha256:{digest}" != head["WARC-Payload-Digest"]:
                        raise ValueError(f"{rows[i]['file']} at {rows[i]['offset']}: the payload does not match its digest")
                    page, ref = head["WARC-Page-ID"], head.get("WARC-Refers-To-Page")
                    out.append({"page_id": int(page) if page else None, "url": head["WARC-Target-URI"], "payload_bytes": n, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(ref) if ref else None, "payload": body if payload and whole else None})
        return pa.Table.from_pylist(out, schema=OUT if payload else pa.schema([f for f in OUT if f.name != "payload"]))

    stretch = F.floor(F.col("offset") / STRETCH)
    return index.select("file", "offset", "length").groupBy("file", stretch).applyInArrow(fetch, RECORDS + (", payload binary" if payload else ""))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write(decide(pages), f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, d.payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from d left join f on d.payload_digest = f.payload_digest and payload_bytes >= 100
"""
