"""WARC archives: one gzip member per record, written and read back in sequence.

``write_archives`` turns records into archives of about ``ARCHIVE_BYTES``: rows of
(archive, content), the content being a complete ``.warc.gz`` file. ``read_archives``
takes such rows, or those of ``spark.read.format("binaryFile")`` renamed alike. It
feeds each archive in small steps through zlib, one member at a time, frames the
block by its content length, and checks the block and payload digests. Only the
record at hand is held; without ``payloads`` not even its block.

Records with equal payloads of at least ``min_bytes`` share one response, the one with the
smallest page_id; the others are revisit records that refer to it and carry no payload.

Defined results: a null html is an empty payload; rows that repeat the smallest page_id
with the same payload are responses too; a page without id refers to the smallest id of
its payload and is itself a response only if no page of that payload has an id; null
urls are left out of the record, control characters in urls are percent-encoded; extra
columns play no part. A record that breaks the framing or fails a digest comes back with
``fault`` set, and reading goes on with the next gzip member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratalake.scratch import written

# Format constants of WARC 1.0 and RFC 4648.
VERSION = b"WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_ID = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
MIN_BYTES = 0
ARCHIVE_BYTES = 4 << 20
FEED = 64 << 10
GZIP = 31  # zlib window bits: gzip framing
RECORD = """archive string, record_id string, record_type string, target_uri string,
    refers_to string, payload_bytes bigint, payload_digest string, fault string,
    payload binary"""


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 20 bits are four base-32 digits."""
    digits = F.sha1(data)
    groups = [
        F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.upper(F.concat(*groups)), BASE32HEX, BASE32)


def as_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select(
        "page_id",
        "url",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
    )
    shared = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    rows = rows.join(shared, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "page_id",
        "url",
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<{RECORD_ID}{'' if page_id is None else page_id}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(row: dict) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"")
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _id(row["page_id"]),
        "WARC-Date": DATE,
    }
    if row["url"] is not None:
        headers["WARC-Target-URI"] = _uri(row["url"])
    if row["record_type"] == "revisit":
        headers["WARC-Profile"] = PROFILE
        headers["WARC-Refers-To"] = _id(row["refers_to"])
    headers |= {
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "WARC-Block-Digest": f"sha1:{_digest(block)}",
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return packer.compress(record) + packer.flush()


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): the records of a partition in archives of about this size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, content = TaskContext.get().partitionId(), 0, bytearray()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                content += member(record_bytes(row))
                if len(content) >= archive_bytes:
                    yield _archive(part, number, content)
                    number, content = number + 1, bytearray()
        if content:
            yield _archive(part, number, content)

    return records.mapInArrow(pack, "archive string, content binary")


def _archive(part: int, number: int, content: bytearray) -> pa.RecordBatch:
    name = f"pages-{part:06d}-{number:06d}.warc.gz"
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([bytes(content)], pa.binary())], ["archive", "content"]
    )


class _Record:
    """Incremental parser of one uncompressed record: header, framed block, trailer."""

    def __init__(self, keep: bool):
        self.head, self.fields, self.keep = bytearray(), None, keep
        self.http, self.payload, self.left, self.tail = bytearray(), bytearray(), 0, bytearray()
        self.block_sha, self.payload_sha = hashlib.sha1(), hashlib.sha1()
        self.payload_bytes, self.in_http, self.fault = 0, True, None

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            data = bytes(self.head[end + 4 :])
            self._header(bytes(self.head[:end]))
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.tail += rest[: 8 - len(self.tail)]
        self.block_sha.update(block)
        if self.in_http:
            self.http += block
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            self.in_http = False
            block = bytes(self.http[end + 4 :])
            del self.http[end:]
        self.payload_sha.update(block)
        self.payload_bytes += len(block)
        if self.keep:
            self.payload += block

    def _header(self, head: bytes) -> None:
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        self.fields = {}
        for line in lines:
            name, _, value = line.partition(":")
            self.fields[name.strip().lower()] = value.strip()
        size = self.fields.get("content-length", "")
        if version != VERSION.decode():
            self.fault = "version"
        elif not size.isdigit():
            self.fault = "content length"
        self.left = int(size) if size.isdigit() else 0

    def _named(self, name: str) -> str | None:
        value = (self.fields or {}).get(name)
        return value.removeprefix("sha1:") if value else None

    def _reference(self, name: str) -> str | None:
        value = self._named(name)
        return value and value.strip("<>").removeprefix(RECORD_ID)

    def row(self, archive: str, fault: str | None) -> dict:
        kind = self._named("warc-type")
        digest = lambda sha: base64.b32encode(sha.digest()).decode()
        length = re.search(rb"(?i)content-length:\s*(\d+)", bytes(self.http))
        uri = self._named("warc-target-uri")
        fault = fault or self.fault
        if not fault and (self.fields is None or self.left or bytes(self.tail) != b"\r\n\r\n"):
            fault = "framing"
        if not fault and self._named("warc-block-digest") not in (None, digest(self.block_sha)):
            fault = "block digest"
        whole = kind != "revisit"
        named = self._named("warc-payload-digest")
        if not fault and whole and named not in (None, digest(self.payload_sha)):
            fault = "payload digest"
        return {
            "archive": archive,
            "record_id": self._reference("warc-record-id"),
            "record_type": kind,
            "target_uri": uri and unquote(uri),
            "refers_to": self._reference("warc-refers-to"),
            "payload_bytes": self.payload_bytes if whole else length and int(length[1]),
            "payload_digest": named or digest(self.payload_sha),
            "fault": fault,
            "payload": bytes(self.payload) if self.keep and whole else None,
        }


def read_records(archive: str, content: bytes, payloads: bool = False) -> Iterator[dict]:
    """Records of one archive in order, decompressed in steps of ``FEED`` bytes."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflate, record, fault = zlib.decompressobj(GZIP), _Record(payloads), None
        try:
            while not inflate.eof and at < len(view):
                step = view[at : at + FEED]
                data = inflate.decompress(step, FEED)
                while data:
                    record.feed(data)
                    if inflate.eof:  # zlib keeps its input tail here; it must not be fed again
                        break
                    data = inflate.decompress(inflate.unconsumed_tail, FEED)
                at += len(step) - len(inflate.unused_data)
            if not inflate.eof:
                fault = "truncated member"
        except zlib.error:
            fault = "damaged member"
            following = content.find(b"\x1f\x8b\x08", at + 1)
            at = following if following > 0 else len(view)
        yield record.row(archive, fault)


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of (archive, content) rows, see ``RECORD``."""
    schema = pa.schema(
        [(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in (
            "archive", "record_id", "record_type", "target_uri", "refers_to",
            "payload_bytes", "payload_digest", "fault")] + [("payload", pa.binary())]
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for row in read_records(name.as_py(), content.as_py() or b"", payloads):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 10_000 or held >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("archive", "content").mapInArrow(unpack, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write one record per page, read the archives back, and report what they say."""
    archives = written(write_archives(as_records(pages, min_bytes)), "archives")
    records = read_archives(archives)
    number = lambda name: F.expr(f"try_cast({name} AS BIGINT)")
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "fault",
    )
