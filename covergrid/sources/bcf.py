"""BCF files: the position of each record. A file is read by one task."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from covergrid.sources.bam import Blocks, open_file


def _contig_names(text: str) -> dict[int, str]:
    """Contigs by the number that records call them: IDX where a header line has it, else their order."""
    out = {}
    for i, line in enumerate(re.findall(r"^##contig=<(.*)>\s*$", text, re.M)):
        name, number = re.search(r"(?:^|,)ID=([^,]+)", line), re.search(r"(?:^|,)IDX=(\d+)", line)
        out[int(number[1]) if number else i] = name[1]
    return out


def sites(spark: SparkSession, path: str) -> DataFrame:
    """(ref, start, stop): one position a record."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for name in b.column(0).to_pylist():
                with open_file(name) as f:
                    blocks = Blocks(f)
                    if blocks.read(5)[:3] != b"BCF":
                        raise ValueError(f"{name} is not a BCF file")
                    names = _contig_names(blocks.read(struct.unpack("<I", blocks.read(4))[0]).rstrip(b"\0").decode())
                    held = []
                    while len(size := blocks.read(8)) == 8:
                        shared, individual = struct.unpack("<II", size)
                        chrom, pos = struct.unpack_from("<ii", blocks.read(shared))
                        blocks.read(individual)
                        held.append({"ref": names[chrom], "start": pos, "stop": pos + 1})
                        if len(held) >= 10_000:
                            yield pa.RecordBatch.from_pylist(held)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held)

    return spark.createDataFrame([(path,)], "path string").mapInArrow(batches, "ref string, start bigint, stop bigint")
