"""The engine: named operations over reads, regions and user-defined processors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from covergrid.functions import cigar
from covergrid.operators import base_depth as _base
from covergrid.operators import only_depth as _only
from covergrid.operators import regions as R

#: A region processor: a region (tid, ref, start, stop) and its reads (pandas) in, output rows out.
Processor = Callable[[dict, pd.DataFrame], pd.DataFrame]


@dataclass
class Engine:
    """Reads and their contigs; operations return DataFrames."""

    spark: SparkSession
    reads: DataFrame
    contigs: DataFrame
    #: The BAM file that the reads come from, so that regions can be fetched by its index.
    bam: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        """A SAM (also gzipped) or BAM file."""
        from covergrid.sources import bam, text

        if path.endswith(".bam"):
            return cls(spark, bam.reads(spark, path), bam.contigs(spark, path), path)
        if path.endswith(".cram"):
            raise NotImplementedError("CRAM is not supported: convert to BAM or SAM")
        return cls(spark, text.sam_reads(spark, path), text.sam_contigs(spark, path))

    def regions(self, bed: str | None = None, vcf: str | None = None, merge: bool = True) -> DataFrame | None:
        """The regions of a BED file, the sites of a VCF or BCF file, or both."""
        from covergrid.sources import bcf, text

        sides = []
        if bed:
            sides.append(R.resolve(text.bed_intervals(self.spark, bed), self.contigs))
        if vcf:
            sites = bcf.sites(self.spark, vcf) if vcf.endswith(".bcf") else text.vcf_intervals(self.spark, vcf)
            sides.append(R.resolve(sites, self.contigs))
        if not sides:
            return None
        if len(sides) == 2:
            return R.united(*sides, merge=merge)
        return R.merged(sides[0]) if merge else sides[0]

    def near(self, regions: DataFrame | None) -> DataFrame:
        """The reads that can overlap the regions: of an indexed BAM file only those parts that hold them are read."""
        from covergrid.sources import bam

        if self.bam is None or regions is None:
            return self.reads
        asked = regions.select("tid", "start", "stop").limit(R.SMALL + 1).collect()
        return self.reads if len(asked) > R.SMALL else bam.reads(self.spark, self.bam, regions=[tuple(r) for r in asked])

    def base_depth(self, regions: DataFrame | None = None, **options) -> DataFrame:
        return _base.base_depth(self.near(regions), self.contigs, regions, **options)

    def only_depth(self, regions: DataFrame | None = None, **options) -> DataFrame:
        return _only.only_depth(self.near(regions), self.contigs, regions, **options)

    def run(self, processor: Processor, schema: str, regions: DataFrame | None = None, *, chunksize: int = 1_000_000, merge: bool = True) -> DataFrame:
        """Any per-region computation: each region, in pieces of chunksize, is given to the processor once
        with the reads that overlap it (none: an empty frame), by pos and ord. A piece is what one task holds in
        memory: texts and lists of its reads stay Arrow columns, as Python objects would take several times as much."""
        places = R.whole(self.contigs) if regions is None else R.merged(regions) if merge else regions
        places = R.chunked(places, chunksize)
        reads = self.near(regions)
        columns = [c for c in reads.columns if c not in ("tid", "ref")]
        spans = reads.select("tid", F.col("pos").alias("start"), (F.col("pos") + F.greatest(cigar.span(F.col("cigar")), F.lit(1))).alias("stop"), F.struct(*columns).alias("read"))
        hits = R.clip(spans, places, ["read"]).select("rid", "read")
        # One stream: a region's row, then its reads. Spark sorts, so that no task sorts or copies a piece.
        rows = places.select("rid", F.struct("tid", "ref", "start", "stop").alias("region")).unionByName(hits, allowMissingColumns=True)
        dealt = rows.repartition("rid").sortWithinPartitions("rid", F.col("region").isNull(), "read.pos", "read.ord")
        return dealt.mapInArrow(_processed(processor, to_arrow_schema(StructType.fromDDL(schema))), schema)


def _processed(processor: Processor, schema: pa.Schema):
    def kept(t: pa.DataType):
        return pd.ArrowDtype(t) if pa.types.is_nested(t) or pa.types.is_string(t) or pa.types.is_large_string(t) else None

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        region = parts[0]["region"][0].as_py()
        reads = pa.Table.from_batches([pa.RecordBatch.from_struct_array(b["read"]) for b in parts]).slice(1)
        parts.clear()
        out = processor(region, reads.to_pandas(types_mapper=kept, split_blocks=True, self_destruct=True))
        if not set(schema.names) <= set(out.columns):
            out = out.set_axis(schema.names, axis=1)
        return pa.RecordBatch.from_pandas(out[schema.names], schema=schema, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            begins = np.flatnonzero(b["region"].is_valid().to_numpy(zero_copy_only=False)).tolist() if b.num_rows else []
            for a, z in zip([0, *begins], [*begins, b.num_rows]):
                if a in begins and held:
                    yield one(held)
                if z > a:
                    held.append(b.slice(a, z - a))
        if held:
            yield one(held)

    return run
