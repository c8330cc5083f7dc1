"""WARC archives of web pages: segmented writing, and reassembly on reading.

Writing: a page becomes an HTTP response in chunked transfer framing, in one
record or, where that is long, in a first record and continuation records. Of
pages with equal payloads, all but the one with the smallest id become revisit
records that name it. Archives are written to a shared folder by Spark's writer.

Reading: each archive is parsed by its records' content lengths. Records that
belong to one origin are put in order of their segment numbers, checked against
the total length, and the chunked framing is taken off. Segments that are all in
one archive are joined where they are read; only others are shuffled by origin.

An archive has ARCHIVE_BYTES of records, and one more at most, so reading one takes
bounded memory.

Nulls: a null html is an empty payload; a null url leaves the target out; a page
without an id is always a response, and nothing refers to it. Rows that repeat a
page's id and payload are responses (or revisits) alike, one record each. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
#: Shorter payloads are never revisits.
LEAST_BYTES = 100
ARCHIVE_BYTES = 16 << 20
#: A frequent payload's rows are dealt over so many join keys.
SALTS = 16
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_DATE = "2024-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive that can't be read whole."""


def _cut_points(data: bytes, most: int) -> list[int]:
    """Cuts at most `most` bytes apart, none inside a UTF-8 character."""
    at, n = [0], len(data)
    while n - at[-1] > most:
        k = at[-1] + most
        while data[k] & 0xC0 == 0x80:
            k -= 1
        at.append(k)
    return [*at, n]


def chunked(payload: bytes, most: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer framing."""
    at = _cut_points(payload, most) if payload else [0]
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(at, at[1:], strict=False)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ArchiveError("chunked body without an end")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ArchiveError("chunk of another length than stated")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """All records of one page; a revisit of page `first` where that is given."""
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    own = record_id(page_id, digest)
    base = [("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest)), ("WARC-Refers-To-Page-ID", first)]
        return [_record([*more, *base], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    at = _cut_points(block, segment)
    if len(at) == 2:
        return [_record([("WARC-Type", "response"), *base], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Segment-Number", 1), *base], block[: at[1]])]
    for k in range(1, len(at) - 1):
        last = k == len(at) - 2
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, f"{digest}:{k + 1}")), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k + 1), ("WARC-Segment-Total-Length", len(block) if last else None)]
        out.append(_record(more, block[at[k] : at[k + 1]]))
    return out


def parse(data: bytes):
    """(fields by lower-case name, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ArchiveError(f"no record at byte {at}")
        fields = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.lower()] = v.strip()
        n = int(fields["content-length"])
        at = end + 4 + n
        if data[at : at + 4] != b"\r\n\r\n":
            raise ArchiveError("record of another length than stated")
        yield fields, data[end + 4 : at]
        at += 4


_DONE = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_DONE_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_DONE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(x: str | None) -> int | None:
    return int(x) if x is not None else None


def page(fields: dict[str, str], block: bytes) -> tuple:
    """What a whole record says of its page; a response's payload is held against its digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        n = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        return _number(fields.get("warc-page-id")), n, digest, "revisit", int(fields["warc-refers-to-page-id"])
    payload = unchunked(body)
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ArchiveError(f"{fields['warc-record-id']}: payload of another digest")
    return _number(fields.get("warc-page-id")), len(payload), digest, "response", None


def reassemble(segments: list[tuple[int, int | None, dict | None, bytes]]) -> list[tuple[dict, bytes]]:
    """Whole records of one origin, from (number, total length, fields of the first, block); repeated rows give repeats."""
    by: dict[int, list] = {}
    for s in segments:
        by.setdefault(s[0], []).append(s)
    copies = len(by.get(1, ()))
    if sorted(by) != list(range(1, len(by) + 1)) or any(len(x) != copies for x in by.values()):
        raise ArchiveError("segments are missing")
    block = b"".join(by[k][0][3] for k in range(1, len(by) + 1))
    if by[len(by)][0][1] != len(block):
        raise ArchiveError("segments of another total length than stated")
    return [(by[1][0][2], block)] * copies


def write(pages: DataFrame, folder: str, segment: int = SEGMENT_BYTES, most: int = ARCHIVE_BYTES) -> None:
    """Write every row of `pages` as records into gzip-compressed archives under `folder`."""
    rows = K.with_columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = rows.where(F.octet_length("html") >= LEAST_BYTES)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(firsts, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("first"))

    def archive(out: list[bytes]) -> pa.RecordBatch:
        # the writer's line end is the last byte
        return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary()).cast(pa.string())], ["value"])

    def run(batches):
        out, size = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                for row in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    for r in records(row[0], row[1], row[2].encode(), row[3], row[4], segment):
                        out.append(r)
                        size += len(r)
                        if size >= most:
                            yield archive(out)
                            out, size = [], 0
        if out:
            yield archive(out)

    joined.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).mode("overwrite").text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives."""
    whole = "done boolean, origin string, number int, total long, fields array<string>, block binary"
    names = ["done", "origin", "number", "total", "fields", "block", *_DONE]
    kinds = [pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary(), *_DONE_KINDS]

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                data = zlib.decompress(raw.as_py(), 31)
                out, parted = [], {}
                for fields, block in parse(data):
                    k = _number(fields.get("warc-segment-number"))
                    if k is None:
                        out.append((True, None, None, None, None, None, *page(fields, block)))
                    else:
                        origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                        parted.setdefault(origin, []).append((k, _number(fields.get("warc-segment-total-length")), fields if k == 1 else None, block))
                for origin, segments in parted.items():
                    try:
                        out += [(True, None, None, None, None, None, *page(*x)) for x in reassemble(segments)]
                    except ArchiveError:  # others of its segments are elsewhere
                        out += [(False, origin, k, n, [y for x in f.items() for y in x] if f else None, block, *[None] * 5) for k, n, f, block in segments]
                for lo in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 2000], strict=True), kinds, strict=True)], names)

    def join(t: pa.Table) -> pa.Table:
        segments = [(x["number"], x["total"], dict(zip(x["fields"][::2], x["fields"][1::2], strict=True)) if x["fields"] else None, x["block"]) for x in t.to_pylist()]
        out = [page(*x) for x in reassemble(segments)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _DONE_KINDS, strict=True)], _DONE)

    seen = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content").mapInArrow(run, f"{whole}, {_DONE_SCHEMA}")
    rest = seen.where("not done").select("origin", "number", "total", "fields", "block").groupBy("origin").applyInArrow(join, _DONE_SCHEMA)
    return seen.where("done").select(*_DONE).unionByName(rest)
