"""WARC archives as chunked record tables.

A record is rows of (record, chunk number, bytes). Payloads, which the input has whole, are cut one chunk at a time
before they leave the JVM, written chunk by chunk into a gzip member per record, and read back the same way, each
chunk row carrying the SHA-1 of the payload so far. Neither the writer nor the reader of archives holds a whole record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, keep_until_exit, sent_if_small, shared_dir, table, written

CHUNK = 256 * 1024
#: Records of one batch between the JVM and Python, which bounds it to this many chunks.
ROWS = 128
#: Bytes at which a task goes on to another file.
FILE_BYTES = 256 * 1024 * 1024

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: URLs
_MANIFEST = "file string, records long, bytes long"
CHUNKS = (
    "record_id string, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, "
    "chunk_no int, chunk_bytes int, prefix_digest string, is_last boolean, data binary"
)


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, sha1, payload_bytes, record_type, refers_to): what is written for each page.

    Null html counts as empty. Of equal payloads, rows with the smallest page_id are responses and the
    others revisit it; ids that are null come last, and payloads that only they have are responses.
    """
    html = F.coalesce("html", F.lit(""))
    sha1 = F.sha1(html).alias("sha1")
    # Only digests that repeat, without their payloads, are sent to the pages.
    first = pages.select("page_id", sha1).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    first = sent_if_small(written(first.select(F.col("sha1").alias("own"), "first_id", "n"), "warc-repeated"))
    keyed = pages.select("page_id", "url", html.alias("html"), sha1, F.octet_length(html).cast("long").alias("payload_bytes"))
    again = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return keyed.join(first, F.col("sha1") == F.col("own"), "left").select(
        "page_id", "url", "html", "sha1", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"),
    )


def chunked(planned: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """A row for each chunk of each payload, in order; a revisit, and an empty payload, has one empty chunk."""
    raw: Column = F.col("html").cast("binary")
    last = F.when(F.col("record_type") == "response", F.greatest(F.ceil(F.col("payload_bytes") / chunk_bytes) - 1, F.lit(0))).otherwise(0).cast("int")
    numbered = planned.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    data = F.when(F.col("record_type") == "response", F.substring(raw, F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return numbered.select("page_id", "url", "sha1", "payload_bytes", "record_type", "refers_to", "chunk_no", data.alias("data"))


def _head(row: dict, name: str) -> bytes:
    """WARC header and HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    size = len(http) + (row["payload_bytes"] if row["record_type"] == "response" else 0)
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]) if row["url"] is not None else None),
        ("WARC-Payload-Digest", f"sha1:{digest32(bytes.fromhex(row['sha1']))}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row["record_type"] == "revisit" else None),
        ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(row['refers_to']))}>" if row["refers_to"] is not None else None),
        ("Page-ID", row["page_id"]), ("Refers-To-Page-ID", row["refers_to"]),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", size),
    ]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n" + http


def _info(name: str) -> bytes:
    """A warcinfo record, which begins each file."""
    body = b"software: quire\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 3, mtime=0)


def write(chunks: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes chunk rows (as from ``chunked``, a record's rows adjacent) as .warc.gz files under ``path``; gives the manifest.

    File names follow the partition, and a file appears only when complete, so a task that runs again replaces its own files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part = Shared(path), TaskContext.get().partitionId()
        rows = (row for batch in batches for k in range(0, batch.num_rows, ROWS) for row in batch.slice(k, ROWS).to_pylist())
        held, number, done = next(rows, None), 0, []

        def members(name: str) -> Iterator[bytes]:
            nonlocal held
            size, records = 0, 0
            yield _info(name)
            while held is not None and (not records or size < file_bytes):
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                record = str(held["page_id"]) if held["page_id"] is not None else f"{part}/{number}/{records}"
                out = [pack.compress(_head(held, record))]
                while True:
                    out.append(pack.compress(held["data"]))
                    size += sum(map(len, out))
                    yield from out
                    out = []
                    held = next(rows, None)
                    if held is None or held["chunk_no"] == 0:
                        break
                yield (end := pack.compress(b"\r\n\r\n") + pack.flush())
                size, records = size + len(end), records + 1
            counted.append(records)

        while held is not None:
            counted: list[int] = []
            name = f"part-{part:05d}-{number:05d}.warc.gz"
            size = store.put(name, members(name))
            done.append((name, counted[0], size))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return written(chunks.mapInArrow(run, _MANIFEST), "warc-manifest", f"{path}-manifest")


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.decode("utf-8", "replace").partition(":") for line in lines)}


def _line(f) -> bytes:
    """A line with its end, however long."""
    parts = [f.readline(65_536)]
    while parts[-1] and not parts[-1].endswith(b"\n"):
        parts.append(f.readline(65_536))
    return b"".join(parts)


def _block(f) -> list[bytes]:
    """Lines up to the empty one."""
    out = []
    while (line := _line(f)) not in (b"\r\n", b"\n", b""):
        out.append(line)
    return out


def records(f, chunk_bytes: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an uncompressed WARC stream: responses and revisits; other records are passed over."""
    while line := _line(f):
        if not line.startswith(b"WARC/"):
            continue  # the empty lines after a record
        head = _headers(_block(f))
        left = int(head.get("content-length", 0))
        kind = head.get("warc-type")
        if kind in ("response", "revisit"):
            http = _block(f)
            left -= sum(map(len, http)) + 2
            web = _headers(http[1:])
            number = lambda k: int(head[k]) if k in head else None
            row = {
                "record_id": head.get("warc-record-id"), "record_type": kind, "page_id": number("page-id"), "refers_to": number("refers-to-page-id"), "url": head.get("warc-target-uri"),
                "payload_bytes": left if kind == "response" else int(web.get("content-length", 0)), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
            }
            so_far, k = hashlib.sha1(), 0
            while True:
                data = f.read(min(chunk_bytes, left))
                if left and not data:
                    raise ValueError(f"{row['record_id']}: the archive ends within the record")
                left -= len(data)
                so_far.update(data)
                now = digest32(so_far.digest())
                if not left and kind == "response" and now != row["payload_digest"]:
                    raise ValueError(f"{row['record_id']}: the payload's digest is {now}, not {row['payload_digest']}")
                yield row | {"chunk_no": k, "chunk_bytes": len(data), "prefix_digest": now, "is_last": not left, "data": data}
                k += 1
                if not left:
                    break
        while left:
            left -= len(f.read(min(chunk_bytes, left)))


def read(manifest: DataFrame, path: str, chunk_bytes: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` names. data: False leaves the bytes out."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Shared(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open(name) as raw, gzip.GzipFile(fileobj=raw) as f:
                    rows, held = [], 0
                    for row in records(f, chunk_bytes):
                        rows.append(row if data else row | {"data": None})
                        held += row["chunk_bytes"] if data else 0
                        if len(rows) >= 1000 or held >= 16 * chunk_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    files = max(1, manifest.count())
    return manifest.select("file").repartition(files).mapInArrow(run, CHUNKS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record, reads the archives back, and gives each page's record."""
    path = keep_until_exit(spark, shared_dir(spark, "warc"))
    manifest = write(chunked(plan_records(table(spark, sf_dir, "pages"))), path)
    return read(manifest, path, data=False).filter("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
