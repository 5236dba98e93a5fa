"""Sinks: ordered tab-separated output, as a folder or as one block-gzipped file."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covergrid.operators.regions import small

# Fixed values of the block-gzip format: block size and the empty block that ends a file.
BLOCK = 0xFF00
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def ordered(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows in header order, then by position."""
    names = {"REF": "POS", "chrom": "chromStart"}
    ref = next(c for c in names if c in rows.columns)
    tids = contigs.select(F.col("tid").alias("__tid"), F.col("ref").alias("__ref"))
    joined = rows.join(small(tids), F.col(ref) == F.col("__ref"), "left")
    return joined.orderBy("__tid", names[ref]).select(*rows.columns)


def write_tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    """One part file a partition, in order; booleans and numbers as text."""
    rows.write.option("sep", "\t").option("header", header).option("emptyValue", "").mode("overwrite").csv(path)


def block(data: bytes, level: int = 2) -> bytes:
    """One block of the block-gzip format."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    head = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<2I", zlib.crc32(data), len(data))


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def _lines(rows: DataFrame) -> Column:
    return F.concat(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit("\n"))


def stream(rows: DataFrame, out: BinaryIO, header: bool = True, bgzip: bool = False, level: int = 2) -> None:
    """The rows in their order to an open file; the driver holds one partition of them at a time."""
    held = ("\t".join(rows.columns) + "\n").encode() if header else b""
    for r in rows.select(_lines(rows).alias("line")).toLocalIterator(prefetchPartitions=True):
        held += r.line.encode()
        while len(held) >= BLOCK:
            out.write(block(held[:BLOCK], level) if bgzip else held[:BLOCK])
            held = held[BLOCK:]
    if held:
        out.write(block(held, level) if bgzip else held)
    if bgzip:
        out.write(EOF)
    out.flush()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path that driver and executors share: in spark.checkpoint.dir, or in local mode a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="covergrid-")
    path = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def spooled(spark: SparkSession, source: BinaryIO) -> str:
    """Copies a stream (standard input) to where Spark can read it; the path."""
    fs, base = _fs(folder := shared_folder(spark))
    fs.create_dir(base, recursive=True)
    first = source.read(1 << 20)
    name = "input.tsv.gz" if first[:2] == b"\x1f\x8b" else "input.tsv"
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        while first:
            out.write(first)
            first = source.read(1 << 20)
    return f"{folder}/{name}"


def write_bgzf(rows: DataFrame, path: str, header: bool = True, level: int = 2) -> None:
    """One block-gzipped file, rows in the order they have. Each partition is compressed by its own task
    into a part beside the target; blocks concatenate, so the driver only strings the parts together.
    The path must be on storage that driver and executors share."""
    line = _lines(rows)
    folder = f"{path}.parts-{uuid.uuid4().hex}"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        name, order, held, out = f"{base}/{uuid.uuid4().hex}", None, b"", None
        for b in parts:
            if b.num_rows and order is None:
                order, out = b.column(0)[0].as_py(), fs.open_output_stream(name, compression=None)
            held += "".join(b.column(1).to_pylist()).encode()
            while len(held) >= BLOCK:
                out.write(block(held[:BLOCK], level))
                held = held[BLOCK:]
        if out:
            if held:
                out.write(block(held, level))
            out.close()
            yield pa.RecordBatch.from_pydict({"order": pa.array([order], pa.int32()), "name": [name]})

    made = rows.select(F.spark_partition_id().alias("order"), line.alias("line")).mapInArrow(batches, "order int, name string").collect()  # a row a partition
    fs, target = _fs(path)
    with fs.open_output_stream(target, compression=None) as out:
        if header:
            out.write(block(("\t".join(rows.columns) + "\n").encode(), level))
        for r in sorted(made, key=lambda r: r.order):
            with fs.open_input_stream(r.name, compression=None) as part:
                while data := part.read(1 << 20):
                    out.write(data)
        out.write(EOF)
    if made:
        fs.delete_dir(_fs(folder)[1])
