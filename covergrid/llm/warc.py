"""WARC: a writer of one gzip member a record, and a splittable reader.

Writing. Each task streams its rows into one archive in the shared folder. Of records with equal
payloads (by SHA-256 and length) of REVISIT_BYTES or more, the one with the largest id is a response
and carries the payload; the others are revisit records that refer to it. Largest ids are found by
an aggregation, so a payload that a third of all pages share costs each task one row; the list of
revisits then meets the pages by their ids, so no payload is ever moved by its content.

Reading. Archives are divided into byte ranges. A task scans its range for gzip magic, validates each
candidate by inflating the start of the member and decoding a WARC header there, and owns the records
of the members that start inside its range; from the first one on it follows member after member,
reading past its end for the last. Magic bytes inside compressed data fail validation. A member may hold
any number of records, of any type, from any writer; what follows them other than line ends fails the job.

Archives are opened through pyarrow's file systems by URI, so executors and driver need not share a
local disk; a task's attempts write to names of their own, and only the names that finished tasks
returned are read.

Defined results: a null html is an empty payload; control characters, spaces and % in a URL are percent-encoded
in the archive and come back as they were; null ids and URLs come back null; rows that repeat the largest id of a
payload are responses each; records without an id can't be referred to and are responses. Of records that this
writer didn't make, page_id and refers_to are null where their ids don't name a page; html is the payload
of responses and resources (of HTTP, what follows its header), else null; payload_bytes is its length, for others the HTTP
header's Content-Length or null; payload_digest is the SHA-1 of a payload that is there, else the record's own, or null.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergrid.llm.util import shared_dir, staged, until_exit

REVISIT_BYTES = 1000
SPLIT_BYTES = 32 << 20
CHUNK = 1 << 16
# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_URL = re.compile(r"[\x00-\x20\x7f%]")


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


# ---- records ------------------------------------------------------------------------------------


def _record_id(page_id: int) -> str:
    return f"<urn:covergrid:page:{page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, length: int, sha1: str, refers_to: int | None) -> bytes:
    """A record's bytes, compressed. A revisit (refers_to) has the HTTP header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", DATE)]
    lines.append(("WARC-Record-ID", f"<{uuid.uuid4().urn}>" if page_id is None else _record_id(page_id)))
    if url is not None:
        lines.append(("WARC-Target-URI", _URL.sub(lambda m: quote(m.group(), safe=""), url)))
    if refers_to is not None:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    lines += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes = field(repr=False)

    def http(self) -> tuple[dict[str, str], bytes]:
        """The fields of a HTTP message's header and what follows it."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return _fields(head.split(b"\r\n")[1:]), payload


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by their lower-case names; a line that starts with white space goes on with the one before."""
    out, last = {}, None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last is not None:
            out[last] += " " + text.strip()
            continue
        k, sep, v = text.partition(":")
        if sep:
            last = k.strip().lower()
            out[last] = v.strip()
    return out


def decode_records(offset: int, data: bytes) -> Iterator[Record]:
    """The records of one member."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":  # what ends a record
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC header at {offset}")
        headers = _fields(data[at:end].split(b"\r\n")[1:])
        size = headers.get("content-length", "")
        if not size.isdecimal():
            raise ValueError(f"record at {offset} has no length")
        block = data[end + 4 : end + 4 + int(size)]
        if len(block) != int(size):
            raise ValueError(f"record at {offset} is cut short")
        yield Record(offset, headers, block)
        at = end + 4 + int(size)


# ---- splittable reader --------------------------------------------------------------------------


def _starts_record(head: bytes) -> bool:
    """Whether a gzip member starts here that starts with a WARC header; head: the next bytes of the file."""
    inflate = zlib.decompressobj(31)
    try:
        return inflate.decompress(head, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _first_member(f, start: int, end: int) -> int | None:
    """The first valid member that starts in [start, end)."""
    at, held, base = start, b"", start
    while base < end:
        f.seek(at)
        more = f.read(CHUNK)
        held += more
        at += len(more)
        i = held.find(MAGIC)
        while i >= 0:
            if base + i >= end:
                return None
            head = held[i : i + 1024]
            if len(head) < 1024 and more:
                f.seek(base + i)
                head = f.read(1024)
            if _starts_record(head):
                return base + i
            i = held.find(MAGIC, i + 1)
        if not more:
            return None
        keep = len(MAGIC) - 1
        base += max(0, len(held) - keep)
        held = held[-keep:]
    return None


def read_range(f, start: int, end: int) -> Iterator[Record]:
    """The records of the open file f that start in [start, end)."""
    at = _first_member(f, start, end)
    if at is None:
        return
    f.seek(at)
    held = b""
    while at < end:
        inflate, out, used = zlib.decompressobj(31), io.BytesIO(), 0
        while not inflate.eof:
            if not held:
                held = f.read(CHUNK)
                if not held:
                    if used:
                        raise ValueError(f"member at {at} is cut short")
                    return
            out.write(inflate.decompress(held))
            used += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        yield from decode_records(at, out.getvalue())
        at += used


# ---- Spark --------------------------------------------------------------------------------------


def _write(folder: str):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        name, size, out = f"pages-{uuid.uuid4().hex}.warc.gz", 0, None
        for b in rows:
            for r in range(b.num_rows):
                page_id, url, html, length, sha1, refers_to = (b.column(k)[r].as_py() for k in range(6))
                record = encode_record(page_id, url, html or b"", length, sha1, refers_to)
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(record)
                size += len(record)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": pa.array([size], pa.int64())})

    return batches


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of pages (page_id, url, html) into archives in folder; returns their path and size."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"length": F.octet_length("html").cast("long"), "sha1": F.sha1("html"), "sha256": F.unhex(F.sha2("html", 256))})
    keys = rows.filter((F.col("length") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select(F.col("page_id").alias("id"), F.col("sha256").alias("s"), F.col("length").alias("l"))
    shared = staged(keys.groupBy("s", "l").agg(F.max("id").alias("holder"), F.min("id").alias("least")).filter("least < holder").drop("least"), "shared")
    revisits = keys.join(shared, ["s", "l"]).filter("id < holder").distinct()
    # Null ids would all meet in one task; nothing refers to them.
    named = rows.filter("page_id is not null")
    joined = named.join(revisits, (F.col("page_id") == F.col("id")) & (F.col("sha256") == F.col("s")), "left").withColumn("refers", F.col("holder"))
    joined = joined.select(*rows.columns, "refers").union(rows.filter("page_id is null").withColumn("refers", F.lit(None).cast("long")))
    written = joined.select("page_id", "url", "html", "length", "sha1", F.col("refers").alias("refers_to")).mapInArrow(_write(folder), "path string, size long")
    listing = f"{folder}/archives"
    written.write.parquet(listing)  # the tasks that finished, and what they wrote
    until_exit(pages.sparkSession, folder)
    return pages.sparkSession.read.parquet(listing)


def _read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    held, size = [], 0
    for b in rows:
        for r in b.to_pylist():
            fs, path = _fs(r["path"])
            with fs.open_input_file(path) as f:
                for record in read_range(f, r["start"], r["end"]):
                    held.append(_row(record))
                    size += len(record.block)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema)
                        held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema)


def _page(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:covergrid:page:(-?\d+)>", record_id or "")
    return int(m[1]) if m else None


def _digest(text: str | None) -> str | None:
    """The hexadecimal SHA-1 that a digest field names, in base 16 or 32."""
    kind, _, value = (text or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except binascii.Error:
            return None
    return value.lower() if re.fullmatch(r"[0-9a-fA-F]{40}", value) else None


def _row(record: Record) -> tuple:
    h = record.headers
    kind, digest, page, payload, size = h.get("warc-type"), _digest(h.get("warc-payload-digest")), _page(h.get("warc-record-id")), None, None
    if kind in ("response", "revisit") and h.get("content-type", "").lower().startswith("application/http"):
        http, rest = record.http()
        if kind == "response":
            payload = rest
        elif http.get("content-length", "").isdecimal():
            size = int(http["content-length"])
    elif kind in ("response", "resource"):
        payload = record.block
    if payload is not None:
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        if page is not None and found != digest:  # other writers may take the digest of a decoded payload
            raise ValueError(f"payload at {record.offset} differs from its digest")
        digest = found
    url = h.get("warc-target-uri")
    return page, None if url is None else unquote(url), payload, size, digest, kind, _page(h.get("warc-refers-to"))


def read(spark: SparkSession, archives: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives (path, size): page_id, url, html (null for a revisit), payload_bytes,
    payload_digest, record_type, refers_to. Ranges of split bytes are dealt out one by one."""
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"), "size")
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, F.col("size")).alias("end"))
    dealt = ranges.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path", "start")
    return dealt.mapInArrow(_read, "page_id long, url string, html binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """Writes pages into archives in the shared folder and reads those back."""
    spark = pages.sparkSession
    return read(spark, write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"), split)
