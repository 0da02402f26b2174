"""WARC archives: a distributed writer with payload deduplication, and a splittable reader.

Every record is a gzip member of its own. The reader deals the files into byte ranges; a task looks for
the gzip magic in its range, proves a candidate by inflating its head to a WARC version line,
and owns the records that start inside its range, reading past the range's end to finish the last.

Scale: digests are grouped with map-side combining, and the pages that revisit another are found on (id, digest) rows
alone. Payloads move once, dealt by page id and digest, so copies of one page go to many tasks, and meet
their row there. A task writes its records as they come, and reads its
range in pieces, so memory holds an Arrow batch of rows and one record. Files are named by attempt and listed in a manifest
that Spark commits, so a lost or repeated task leaves no second copy in what is read.
Files live in the shared folder, opened through pyarrow's file systems (file, hdfs, s3, gs).

Edge cases: a null payload is empty; a null url gives no target header, and line breaks in one are
escaped; a null page id gives a record that is a response and refers to nothing; equal rows with the
largest id are all responses; an empty table writes no file and reads as no rows. Only the
three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import materialise, scratch_dir

MIN_REVISIT = 1000
SPLIT_BYTES = 16 << 20
MAX_TASKS = 100_000  # beyond it, a task reads several ranges
MAGIC = b"\x1f\x8b\x08"
_PIECE = 1 << 20
_DATE = "2000-01-01T00:00:00Z"
_RECORD_ID = "urn:x-page:"


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _headers(values: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in values) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = "" if page_id is None else page_id
    values = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_RECORD_ID}{name}>"), ("WARC-Date", _DATE), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode())]
    if url is not None:
        values.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if refers_to is not None:
        values += [("WARC-Refers-To", f"<{_RECORD_ID}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    values += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(_headers(values) + block + b"\r\n\r\n") + pack.flush()


def plan_records(pages: DataFrame, *, min_revisit: int = MIN_REVISIT, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest (binary SHA-1) and refers_to (null for responses)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    narrow = rows.where(F.octet_length("payload") >= min_revisit).select("page_id", "digest")
    shared = narrow.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    # equal rows give one; a null id equals none, so it never revisits
    revisits = narrow.join(shared, "digest").where("page_id <> last").select("page_id", "digest", "last").distinct()
    joined = rows.join(revisits, ["page_id", "digest"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.col("last").alias("refers_to"))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task and returns the manifest (path, bytes, records) of committed files."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = out = None
        path, n, size = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
        for batch in batches:
            for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                if out is None:
                    store, local = _file(path)
                    store.create_dir(local.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(local, compression=None)
                member = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return materialise(planned.mapInArrow(step, "path string, bytes long, records long"), "warc-manifest")


class _Source:
    """Sequential reads of a file from any place."""

    def __init__(self, path: str) -> None:
        store, local = _file(path)
        self.file = store.open_input_file(local)
        self.size = self.file.size()

    def at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(min(n, max(0, self.size - offset)), offset) if offset < self.size else b""


def _looks_like_record(source: _Source, offset: int) -> bool:
    """Whether the bytes at ``offset`` inflate to the start of a WARC record."""
    try:
        head = zlib.decompressobj(31).decompress(source.at(offset, 4096), 64)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.") or (len(head) < 7 and b"WARC/1.".startswith(head) and head != b"")


def _member(source: _Source, offset: int) -> tuple[bytes, int]:
    """The inflated member at ``offset`` and the offset after it."""
    inflate, parts, at = zlib.decompressobj(31), [], offset
    while not inflate.eof:
        piece = source.at(at, 1 << 16)
        if not piece:
            raise ValueError(f"archive ends inside the record at byte {offset}")
        parts.append(inflate.decompress(piece))
        at += len(piece)
    return b"".join(parts), at - len(inflate.unused_data)


def record_offsets(source: _Source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and inflated bytes of each record that starts in [start, end)."""
    at = start
    while at < min(end, source.size):
        window = source.at(at, min(_PIECE, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        if not _looks_like_record(source, at):
            at += 1
            continue
        try:
            raw, after = _member(source, at)
        except zlib.error:  # a chance likeness inside a record that another range owns
            at += 1
            continue
        yield at, raw
        at = after


def parse(raw: bytes) -> dict:
    """A record's page id, url, type, digest, refers_to, payload size and payload (null for revisits)."""
    head, _, block = raw.partition(b"\r\n\r\n")
    values = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(values["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda name: int(v) if (v := values.get(name, "").strip("<>").removeprefix(_RECORD_ID)) else None
    revisit = values["WARC-Type"] == "revisit"
    digest = base64.b32decode(values["WARC-Payload-Digest"].removeprefix("sha1:"))
    if not revisit and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"payload of record {values['WARC-Record-ID']} does not have its digest")
    return {"page_id": number("WARC-Record-ID"), "url": values.get("WARC-Target-URI"), "record_type": values["WARC-Type"], "payload_bytes": size, "payload_digest": digest.hex(), "refers_to": number("WARC-Refers-To"), "payload": None if revisit else payload}


_FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("at", pa.int64())])
_BATCH_BYTES = 16 << 20


def read_archives(manifest: DataFrame, *, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """All records of the files of a manifest (path, bytes), read by byte ranges."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    # rows of ranges are tiny, so without a number adaptive execution would put them all in one task
    tasks = manifest.agg(F.sum(F.greatest(F.ceil(F.col("bytes") / split_bytes), F.lit(1)))).first()[0] or 1
    ranges = ranges.repartitionByRange(min(int(tasks), MAX_TASKS), "path", "start")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                source, rows, held = _Source(task["path"]), [], 0
                for at, raw in record_offsets(source, task["start"], task["end"]):
                    row = parse(raw) | {"path": task["path"], "at": at}
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    held += len(raw)
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    return ranges.mapInArrow(step, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, path string, at long")


def round_trip(spark: SparkSession, pages: DataFrame, *, min_revisit: int = MIN_REVISIT, split_bytes: int = SPLIT_BYTES, folder: str | None = None) -> DataFrame:
    """Writes the pages to archives and reads them back."""
    folder = folder or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(plan_records(pages, min_revisit=min_revisit), folder)
    return read_archives(manifest, split_bytes=split_bytes, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS last_id FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last_id THEN last_id END AS refers_to FROM p LEFT JOIN m ON p.d = m.d
"""
