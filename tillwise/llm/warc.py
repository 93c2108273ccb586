"""WARC archives: written with one gzip member per record, read back by a sequential reader.

The writer finds equal payloads by digest and length, makes the one with the largest page id a
response and the others revisits of it, and packs records into archives of bounded size. Archives
are rows ``(path, content)``, which is also what Spark's binary file source gives for ``.warc.gz``
files, so the reader serves both. It goes through an archive from front to back: it inflates in
small pieces, ends a member where its stream ends, takes the block by Content-Length, and checks the
payload digest.

Defined cases: a null payload is empty; a null id counts as the smallest, and so does not refer;
pages that share an id and a payload: the one
with the first URL is the response, the rest revisit it (rows equal in all three are one record, and
each is written as the response); a truncated or
damaged archive raises an error that names it; an empty table gives no archive and no record. Other
columns of the pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ship

#: Bytes of compressed records after which the writer begins another archive.
ARCHIVE_BYTES = 4 << 20
#: Bytes that the reader inflates at a time.
PIECE = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


class DamagedArchive(ValueError):
    """A record that does not follow the format, or whose digest differs."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(identifier: str) -> int | None:
    name = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def encode_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record as a gzip member. A revisit carries the digest and length of the payload, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in (url or "urn:none"))
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", _PROFILE)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    header = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(header.encode() + block + b"\r\n\r\n") + pack.flush()


def members(content: bytes) -> Iterator[bytes]:
    """The inflated gzip members of an archive, one after another."""
    at, size = 0, len(content)
    while at < size:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= size:
                raise DamagedArchive("the archive ends inside a member")
            piece = content[at : at + PIECE]
            try:
                out.append(inflate.decompress(piece))
            except zlib.error as error:
                raise DamagedArchive(f"bad compressed data at {at}: {error}") from error
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(out)


def parse_record(data: bytes) -> dict:
    """Headers and payload of one inflated record; lengths and the digest are checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise DamagedArchive("no WARC header")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise DamagedArchive(f"Content-Length of {fields['warc-record-id']} does not frame its block")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    mark = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != stated or digest(payload) != mark):
        raise DamagedArchive(f"payload of {fields['warc-record-id']} differs from its digest")
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "refers_to": page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload_digest": mark,
        "payload_bytes": stated,
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``path, content`` of archives that hold one record per page, written to the shared folder.

    Payload groups are reduced to their largest page before the shuffle, and the pages meet them in
    a join that Spark can split, so a payload that many pages share stays spread out.
    """
    ship(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = keyed.withColumns({"sha": F.sha2("payload", 256), "row": F.xxhash64(F.coalesce("url", F.lit("")))})
    owners = keyed.groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies"))
    owners = owners.where("copies > 1").select(F.col("sha").alias("o_sha"), "owner")
    joined = keyed.join(owners, F.col("sha") == F.col("o_sha"), "left")
    # equal ids with equal payloads: the first by URL answers
    shared = joined.where(F.col("o_sha").isNotNull() & F.col("page_id").eqNullSafe(F.col("owner")))
    twice = shared.groupBy("o_sha").agg(F.count("*").alias("n"), F.min("row").alias("row1")).where("n > 1")
    twice = twice.select(F.col("o_sha").alias("t_sha"), "row1")
    marked = joined.join(twice, (F.col("sha") == F.col("t_sha")) & F.col("page_id").eqNullSafe(F.col("owner")), "left")
    revisit = F.col("o_sha").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("owner")) | (F.col("row") != F.coalesce("row1", "row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer: list[bytes] = []
        total, first = 0, None
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                for page, url, html, owner, again in zip(*(c.to_pylist() for c in part.columns)):
                    record = encode_record(page, url, html.encode(), owner, again)
                    first = record_id(page) if first is None else first
                    buffer.append(record)
                    total += len(record)
                    if total >= archive_bytes:
                        yield _archive(first, buffer)
                        buffer, total, first = [], 0, None
        if buffer:
            yield _archive(first, buffer)

    rows = marked.select("page_id", "url", "payload", "owner", revisit.alias("again"))
    return materialize(rows.mapInArrow(run, "path string, content binary"), "warc")


def _archive(first: str, records: list[bytes]) -> pa.RecordBatch:
    name = f"pages-{hashlib.sha1(first.encode() + records[0]).hexdigest()[:16]}.warc.gz"
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(records)], pa.binary())], ["path", "content"])


_RECORD = [
    ("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("record_type", pa.string(), "string"),
    ("refers_to", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"),
    ("payload", pa.binary(), "binary"),
]


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of archives given as ``path, content``; ``payload`` is left out on request.

    A task holds one archive and a few records at a time.
    """
    ship(archives.sparkSession)
    fields = [f for f in _RECORD if payloads or f[0] != "payload"]

    def flush(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind, _ in fields], [n for n, _, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows: list[dict] = []
                held = 0
                try:
                    for data in members(content):
                        rows.append(parse_record(data))
                        held += len(data) if payloads else 200
                        if held > PIECE * 16:
                            yield flush(rows)
                            rows, held = [], 0
                except (DamagedArchive, KeyError, StopIteration, UnicodeDecodeError) as error:
                    raise DamagedArchive(f"{path}: {error}") from error
                if rows:
                    yield flush(rows)

    return archives.select("path", "content").mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in fields))
