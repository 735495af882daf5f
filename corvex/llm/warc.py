"""WARC archives with revisit resolution.

Only headers (key, address, digest, length) are shuffled by payload digest:
each digest's smallest key becomes its response.  Revisit headers are joined
with that original, and the archives are written with fresh headers: responses
with the payload, revisits with a reference to the record that has it.

Files are written by the tasks into the shared folder under names no other
attempt uses; the manifest that lists them is a Parquet table, so that only the
files of tasks that succeeded count.  Each record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.llm import store

WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 64 << 20
COMPRESSION = 1
_NAMESPACE = uuid.UUID("6f4ad1f8-0b3c-4f0e-9a55-3f2f6a0c7d11")

HEADER = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_digest(raw: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()  # noqa: S324


def record_id(key: int | None, digest: str) -> str:
    """The address of a record: the same for the same key and payload."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}:{digest}')}>"


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit(b""))


def resolve(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The revisits among pages: key, digest (hex SHA-1), original_id and original_url.

    Of the pages with equal payloads of at least min_bytes, those with the
    smallest key are responses, which need no row here; a page without a key is
    a revisit if its payload has a response with one.
    """
    raw = _payload(pages[html])
    heads = pages.select(pages[key].alias("page_id"), pages[url].alias("url"), F.sha1(raw).alias("digest"), F.octet_length(raw).alias("n"))
    heads = heads.where(F.col("n") >= min_bytes).drop("n")
    # Digests are combined before the shuffle; the least (key, url) is the original.
    first = heads.where(F.col("page_id").isNotNull()).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "url")).alias("original"))
    joined = heads.select("page_id", "digest").join(first, "digest")
    other = joined.where(F.coalesce(F.col("page_id") > F.col("original.page_id"), F.lit(True)))
    return other.select("page_id", "digest", F.col("original.page_id").alias("original_id"), F.col("original.url").alias("original_url")).distinct()


def _block(kind: str, page: int | None, url: str | None, digest: str, body: bytes, more: list[str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {WARC_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.translate({10: "%0A", 13: "%0D"}))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", *more, f"Content-Type: {'text/html; charset=utf-8'}", f"Content-Length: {len(body)}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _target(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write(pages: DataFrame, path: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes one record for each page under path (a URI all executors reach); returns the manifest (file, n_records).

    Null html is an empty payload; a null url leaves out the target header;
    rows that repeat are written one by one, and all of an original's rows are
    responses; an empty table writes no file; other columns aren't read.
    """
    raw = _payload(pages[html])
    body = pages.select(pages[key].alias("page_id"), pages[url].alias("url"), raw.alias("payload"), F.sha1(raw).alias("digest"))
    links = resolve(pages, min_bytes, key, url, html)
    # A null key is given a number by digest, so that those rows meet too and do not all go to one task.
    meet = lambda d: F.coalesce(d["page_id"], F.xxhash64(d["digest"]))
    linked = body.alias("b").join(links.alias("l"), (meet(body) == meet(links)) & body["page_id"].eqNullSafe(links["page_id"]) & (body["digest"] == links["digest"]), "left")
    linked = linked.select("b.page_id", "b.url", "b.payload", F.col("l.digest").isNotNull().alias("revisit"), "l.original_id", "l.original_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _target(path)
        files: list[tuple[str, int]] = []
        out, name, size, n = None, "", 0, 0
        try:
            for batch in batches:
                for page, url, payload, revisit, original, original_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        system.create_dir(folder, recursive=True)
                        out, size, n = system.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                    digest = base32_digest(payload)
                    more = []
                    if revisit:
                        more = [f"WARC-Refers-To: {record_id(original, digest)}", f"WARC-Refers-To-Date: {WARC_DATE}", f"WARC-Profile: {PROFILE}"]
                        if original_url is not None:
                            more.append("WARC-Refers-To-Target-URI: " + original_url.translate({10: "%0A", 13: "%0D"}))
                    member = gzip.compress(_block("revisit" if revisit else "response", page, url, digest, b"" if revisit else payload, more), COMPRESSION, mtime=0)
                    out.write(member)
                    size, n = size + len(member), n + 1
                    if size >= FILE_BYTES:
                        out.close()
                        files.append((name, n))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            files.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], ["file", "n_records"])

    return store.stage(linked.mapInArrow(run, "file string, n_records long"), "warc-manifest")


def records(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:  # noqa: ANN001
    """(headers, body) of each gzip member of an open archive; one record is in memory at a time."""
    rest = b""
    while True:
        engine, parts = zlib.decompressobj(31), []
        while not engine.eof:
            rest = rest or stream.read(size)
            if not rest:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(engine.decompress(rest))
            rest = engine.unused_data if engine.eof else b""
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, body[: int(headers["Content-Length"])]


def read(manifest: DataFrame, path: str) -> DataFrame:
    """Headers of all records of the manifest's files, digests verified where there is a payload.

    Revisits are joined with the response that they refer to, for the payload's
    length; one whose response is missing has a null length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _target(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for head, body in records(stream):
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if kind == "response" and base32_digest(body) != digest:
                            raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
                        page = int(head["X-Page-ID"]) if "X-Page-ID" in head else None
                        rows.append((page, head["WARC-Record-ID"], kind, digest, len(body) if kind == "response" else None, head.get("WARC-Refers-To")))
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["page_id", "record_id", "record_type", "payload_digest", "payload_bytes", "target"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spread = manifest.select("file").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4))
    rows = store.stage(spread.mapInArrow(run, "page_id long, record_id string, record_type string, payload_digest string, payload_bytes long, target string"), "warc-headers")
    responses = rows.where("record_type = 'response'")
    originals = responses.groupBy(F.col("record_id").alias("target")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("length"))
    revisits = rows.where("record_type = 'revisit'").join(originals, "target", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.withColumn("payload_bytes", F.col("length")).select(*columns))
