"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Writing: the payload of a page is the HTML in UTF-8. Of equal payloads (by SHA-1) the page with
the smallest id is a response record, the others are revisit records that carry HTTP headers
only. A response's block is an HTTP response with chunked transfer framing; a block longer than
`segment_bytes` is split, its first part in the response record (segment 1) and the rest in
continuation records that name it as their origin; the last one states the total length.
Records are gzip members of their own. Each task writes one file under a temporary name and
moves it when complete.

Reading: whole records are decoded where they are read. Segments are grouped by origin, put in
order of their numbers and checked: numbers without a gap, total length as stated, digest of the
decoded payload as stated. A group is the parts of one record, so it is as large as one page.

Defined cases: null HTML is an empty payload (empty ones equal each other); a null URL is written
as an empty one; repeated rows of the smallest id are all responses; a page with null id refers
to the smallest id, if there is one; an empty table gives no archive and no rows; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, table

READ = "page_id long, record_type string, refers_to long, digest string, payload binary, payload_bytes long, origin string, segment int, total long, block binary"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, gaps are errors."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += size + 2


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return {k.lower(): v for k, v in fields.items()}, body


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    fields, body = http_parts(block)
    return unchunked(body) if fields.get("transfer-encoding") == "chunked" else body


def record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": len(block)}).items() if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", 1, mtime=0)


def page_records(page_id: int | None, url: str, html: str, first: int | None, first_url: str | None, revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    payload, uri, name = html.encode(), (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"<urn:uuid:{uuid.uuid4()}>"
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http;msgtype=response", "Page-Id": page_id}
    if revisit:
        more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": (first_url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Refers-To-Date": DATE, "Refers-To-Page-Id": first}
        yield record(fields | more, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record(fields, block)
        return
    for k, at in enumerate(range(0, len(block), segment_bytes), 1):
        last = {"WARC-Segment-Total-Length": len(block)} if at + segment_bytes >= len(block) else {}
        if k > 1:
            fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Segment-Origin-ID": name}
        yield record(fields | {"WARC-Segment-Number": k} | last, block[at : at + segment_bytes])


def write(pages: DataFrame, segment_bytes: int = 16 << 10, path: str | None = None) -> list[str]:
    """Writes the archives; their paths, one for each task that had rows."""
    path = path or shared_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    firsts = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"))
    roles = rows.join(firsts, "sha").select("page_id", "url", "html", "first", "first_url", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit"))

    def run(batches):
        from pyarrow import fs

        uri = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        store, place = fs.FileSystem.from_uri(uri)
        out = temporary = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(posixpath.dirname(place), recursive=True)
                    temporary = f"{place}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary, compression=None)
                    out.write(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"software: siltstone\r\nformat: WARC File Format 1.1\r\n"))
                for data in page_records(row["page_id"], row["url"], row["html"], row["first"], row["first_url"], row["revisit"], segment_bytes):
                    out.write(data)
        if out is not None:
            out.close()
            store.move(temporary, place)
            yield pa.RecordBatch.from_pydict({"path": [uri]})

    return [r.path for r in roles.mapInArrow(run, "path string").collect()]


def records(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a gzip file with a member for each record."""
    inflate, parts = zlib.decompressobj(31), []
    data = stream.read(size)
    while data:
        parts.append(inflate.decompress(data))
        if inflate.eof:
            data = inflate.unused_data
            inflate = zlib.decompressobj(31)
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = rest[: int(fields["Content-Length"])]
            if fields.get("WARC-Block-Digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
                raise ValueError("a block differs from its digest")
            yield fields, block
            parts = []
            data = data or stream.read(size)
        else:
            data = stream.read(size)
    if parts and any(parts):
        raise ValueError("the archive ends within a record")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """page_id, record_type, refers_to, digest, payload (null for revisits), payload_bytes of every page."""
    if not paths:
        return spark.createDataFrame([], READ).drop("origin", "segment", "total", "block")

    def parse(batches):
        from pyarrow import fs

        for uri in (p for b in batches for p in b.column(0).to_pylist()):
            store, place = fs.FileSystem.from_uri(uri)
            rows, size = [], 0
            with store.open_input_stream(place, compression=None) as stream:
                for fields, block in records(stream):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    row = {"record_type": kind, "page_id": int(fields["Page-Id"]) if "Page-Id" in fields else None, "digest": fields.get("WARC-Payload-Digest", "")[5:]}
                    if kind == "revisit":
                        row |= {"refers_to": int(fields["Refers-To-Page-Id"]), "payload_bytes": int(http_parts(block)[0]["content-length"])}
                    elif "WARC-Segment-Number" in fields:
                        total = fields.get("WARC-Segment-Total-Length")
                        row |= {"origin": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), "segment": int(fields["WARC-Segment-Number"]), "total": total and int(total), "block": block}
                    else:
                        row["payload"] = payload_of(block)
                        row["payload_bytes"] = len(row["payload"])
                    rows.append(row)
                    size += len(block)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _READ)

    def assemble(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                parts = sorted(row["parts"], key=lambda p: p["segment"])
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"segments of {row['origin']} are not whole")
                payload = payload_of(block)
                rows.append({"page_id": row["page_id"], "record_type": "response", "refers_to": None, "digest": row["digest"], "payload": payload, "payload_bytes": len(payload)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(_READ)[:6]))

    def check(batches):
        for batch in batches:
            for stated, payload in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist()):
                if payload is not None and digest(payload) != stated:
                    raise ValueError("a payload differs from its digest")
            yield batch

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    parsed = files.mapInArrow(parse, READ)
    columns = ["page_id", "record_type", "refers_to", "digest", "payload", "payload_bytes"]
    parts = parsed.filter("origin is not null").groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.collect_list(F.struct("segment", "total", "block")).alias("parts"))
    schema = "page_id long, record_type string, refers_to long, digest string, payload binary, payload_bytes long"
    whole = parts.mapInArrow(assemble, schema)
    return parsed.filter("origin is null").select(columns).union(whole.select(columns)).mapInArrow(check, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, write(table(spark, sf_dir, "pages")))
    return pages.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, upper(sha1(coalesce(html, ''))) AS x FROM pages),
b AS (SELECT page_id, h, x, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS d FROM p),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b JOIN f USING (x)
"""
