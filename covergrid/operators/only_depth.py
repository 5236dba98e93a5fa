"""Interval depth: a sweep over delta events, in proportion to reads rather than bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covergrid.functions import cigar
from covergrid.functions.filters import ReadFilter, may_overlap_mate
from covergrid.operators import regions as R

#: Positions swept at a time, as a power of two.
SWEEP_BITS = 16


def united_mates(spans: DataFrame) -> DataFrame:
    """(tid, qname, start, stop): what overlaps or touches under one name becomes one span."""
    by = Window.partitionBy("tid", "qname").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    numbered = marked.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("tid", "qname", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("tid", "start", "stop")


def spans(reads: DataFrame, fast: bool = False, mate_fix: bool = False, keep=ReadFilter()) -> DataFrame:
    """(tid, start, stop) of what counts: aligned blocks, or in fast mode reads from start to end.
    With mate_fix a position counts once for reads of one name that may overlap their mates."""
    passed = reads.filter(keep())

    def of(part: DataFrame) -> DataFrame:
        if fast:
            return part.select("tid", "qname", F.col("pos").alias("start"), (F.col("pos") + cigar.span(F.col("cigar"))).alias("stop")).filter("start < stop")
        # A read without skips is one block: its operations' blocks touch.
        skips = F.exists("cigar", lambda x: x["op"] == "N")
        return cigar.with_blocks(part, "tid", "qname", whole=~skips)

    if not mate_fix:
        return of(passed).select("tid", "start", "stop")
    overlaps = F.coalesce(may_overlap_mate(cigar.span(F.col("cigar"))), F.lit(False))
    return of(passed.filter(~overlaps)).select("tid", "start", "stop").union(united_mates(of(passed.filter(overlaps))))


def sweep(clipped: DataFrame, regions: DataFrame) -> DataFrame:
    """(rid, tid, ref, a, z, depth): maximal runs of equal depth that tile every region.

    Depth is a running sum in two levels: sums by (region, bin) carry into a sum inside each bin, and
    a bin's last run ends at the first event of the next bin that has one. Events carry their region's
    columns along, so nothing is joined or windowed by region alone: no task holds a contig."""
    place = ["rid", "tid", "ref", "stop"]
    at = clipped.select(*place, F.inline(F.array(F.struct(F.col("a").alias("p"), F.lit(1).alias("d"), F.lit(False).alias("opens")), F.struct(F.col("z").alias("p"), F.lit(-1).alias("d"), F.lit(False).alias("opens")))))
    opening = regions.select(*place, F.col("start").alias("p"), F.lit(0).alias("d"), F.lit(True).alias("opens"))
    events = at.filter("p < stop").union(opening).groupBy(*place, "p").agg(F.sum("d").alias("d"), F.max("opens").alias("opens"))
    # Keys that can't be null, so that the join below adds no filter to one side and events are made once.
    never = F.lit(0).cast("bigint")
    events = events.filter("d <> 0 or opens").withColumns({"rid": F.coalesce("rid", never), "bin": F.coalesce(F.shiftright("p", SWEEP_BITS), never)})
    by_bin = events.groupBy("rid", "bin").agg(F.sum("d").alias("total"), F.min("p").alias("first"))
    w = Window.partitionBy("rid").orderBy("bin")  # a row for each bin: few
    carried = by_bin.select(
        "rid", "bin", F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"), F.lead("first").over(w).alias("after")
    )
    inside = Window.partitionBy("rid", "bin").orderBy("p")
    return events.join(carried, ["rid", "bin"]).select(
        "rid", "tid", "ref", F.col("p").alias("a"), F.coalesce(F.lead("p").over(inside), "after", "stop").alias("z"),
        (F.col("carry") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("depth"),
    )


def only_depth(
    reads: DataFrame, contigs: DataFrame, regions: DataFrame | None = None, *, fast: bool = False, mate_fix: bool = False, no_merge: bool = False,
    keep_zeros: bool = False, zero_base: bool = False, bed_format: bool = False, chunksize: int | None = None, keep=ReadFilter(), merge_regions: bool = True, drop_zero_runs: bool = False,
) -> DataFrame:
    """REF, POS, END, DEPTH (or the BED columns). Runs of depth zero are part of merged output unless
    drop_zero_runs is set; with no_merge each position is a row, those of depth zero only with keep_zeros."""
    counted = spans(reads, fast, mate_fix, keep)
    places = R.whole(contigs) if regions is None else R.merged(regions)
    clipped = R.clip_to_contigs(counted, contigs, []) if regions is None else R.clip(counted, places, [])
    # Every position is swept once; regions that share it are given its runs.
    runs = sweep(clipped, places)
    if regions is not None and not merge_regions:
        runs = R.clip(runs.select("tid", F.col("a").alias("start"), F.col("z").alias("stop"), "depth"), regions, ["depth"])
    if chunksize:
        first = F.col("a") - F.col("a") % chunksize
        runs = runs.withColumn("at", F.explode(F.sequence(first, F.col("z") - 1, F.lit(chunksize).cast("bigint"))))
        runs = runs.withColumns({"a": F.greatest("a", "at"), "z": F.least("z", F.col("at") + chunksize)})
    if no_merge:
        runs = runs if keep_zeros else runs.filter("depth <> 0")
        runs = runs.select("tid", "ref", "depth", F.explode(F.sequence(F.col("a"), F.col("z") - 1)).alias("a")).withColumn("z", F.col("a") + 1)
    elif drop_zero_runs:
        runs = runs.filter("depth <> 0")
    shift = 0 if zero_base else 1
    out = runs.select(F.col("ref").alias("REF"), (F.col("a") + shift).alias("POS"), (F.col("z") + shift).alias("END"), F.col("depth").cast("bigint").alias("DEPTH"))
    return bed(out) if bed_format else out


def bed(ranges: DataFrame) -> DataFrame:
    return ranges.select(F.col("REF").alias("chrom"), F.col("POS").alias("chromStart"), F.col("END").alias("chromEnd"), F.lit("").alias("name"), F.col("DEPTH").alias("score"))
