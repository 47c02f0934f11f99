"""WARC archives with revisit resolution.

Headers only (id, digest, length) are grouped by payload digest, with partial aggregation, to find the original of each
repeated payload; revisits are the headers that join it and are not the original. The pages are then joined to the
revisit decisions by page, so that a payload that a third of all pages share moves no payloads to one task. Each task
writes archives of bounded size, one gzip member a record with fresh headers, to the shared folder; only files named in the
committed manifest are read back, so a task that is run again leaves no second copy.

Defined cases: a null html is an empty payload; payloads under ``least`` bytes are all responses; a page without id is a
response and never an original; rows that repeat a page's id and payload have one decision; a null url is written as
``urn:page:<id>``; an empty table writes no archive and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved, scratch

OUT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
MANIFEST = "path string, records bigint, bytes bigint"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def decisions(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of revisits only."""
    heads = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= least)
    first = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null")
    return heads.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def uuid_of(*what: object) -> str:
    """A record id that a second run gives again."""
    return str(uuid.UUID(bytes=hashlib.sha256("\n".join(map(str, what)).encode()).digest()[:16], version=4))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: an HTTP response with its payload, or a revisit with the HTTP headers alone."""
    uri = " ".join((url or f"urn:page:{page_id}").split())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid_of('page', page_id, digest)}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid_of('page', refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = 32 << 20, level: int = 4) -> DataFrame:
    """Write the pages' archives under ``path``; returns the manifest, saved."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ruled = keyed.join(saved(decisions(pages, least), "warc-revisits"), ["page_id", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        out, done = None, []
        for batch in batches:
            for p, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(posixpath.join(folder, name), compression=None), 0, 0
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = packer.compress(record(p, url, payload, digest, refers)) + packer.flush()
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    return saved(ruled.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, MANIFEST), "warc-manifest")


def parse(data: bytes) -> Iterator[tuple]:
    """(page_id, payload bytes, digest, type, refers_to) of each record; a response's digest is taken from its payload."""
    at = memoryview(data)
    while at:
        member = zlib.decompressobj(31)
        raw = member.decompress(at)
        at = at[len(at) - len(member.unused_data) :]
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        revisit = fields["WARC-Type"] == "revisit"
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
        yield (int(fields["X-Page-ID"]) if fields["X-Page-ID"].strip() else None, size if revisit else len(payload), digest, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if revisit else None)


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """The records of the archives that the manifest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for data in batch.column("content"):
                rows = list(parse(data.as_buffer().to_pybytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spark = manifest.sparkSession
    if not manifest.take(1):
        return spark.createDataFrame([], OUT)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    named = files.join(manifest.select(F.col("path").alias("name")), F.element_at(F.split(F.col("path"), "/"), -1) == F.col("name"), "left_semi")
    return named.select("content").mapInArrow(read, OUT)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, path, least), path)


#: DuckDB SQL for ``round_trip`` over pages.
WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d AND n >= 100
"""
