"""Regions: generating, merging, uniting, clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions per bin of the interval join at most and at least, as powers of two; how many such bins a short
#: interval has at most; the bit from which a bin's number tells its level.
BIN_BITS, MIN_BITS = 14, 8
LONG, LEVEL = 16, 58
#: Most rows (of a name and a few numbers) that are broadcast.
SMALL = 200_000


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has no more than SMALL rows; else as it is."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def whole(contigs: DataFrame) -> DataFrame:
    """One region for each contig."""
    return contigs.select(F.col("tid").cast("bigint").alias("rid"), "tid", "ref", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("stop")).filter("stop > 0")


def chunked(regions: DataFrame, size: int) -> DataFrame:
    """Regions cut at multiples of ``size``; a region's pieces are numbered in its place."""
    first = F.col("start") - F.col("start") % size
    pieces = regions.select("rid", "tid", "ref", "start", "stop", F.explode(F.sequence(first, F.col("stop") - 1, F.lit(size).cast("bigint"))).alias("at"))
    cut = pieces.select("rid", "tid", "ref", F.greatest("start", "at").alias("start"), F.least("stop", F.col("at") + size).alias("stop"))
    return cut.withColumn("rid", F.xxhash64("rid", "start"))


def resolve(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ref, start, stop) to regions. Unknown contigs and intervals that end before they start fail the
    job; what lies beyond a contig's end is cut off, and empty intervals go."""
    known = contigs.select("ref", "tid", "length")
    told = lambda what: F.raise_error(F.concat(F.lit(what + ": "), "ref", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string")))
    joined = intervals.select("ref", "start", "stop").join(known, "ref", "left")
    checked = joined.withColumn(
        "stop", F.when(F.col("tid").isNull(), told("unknown contig").cast("bigint")).when(F.col("stop") < F.col("start"), told("interval ends before it starts").cast("bigint")).otherwise(F.least("stop", "length"))
    )
    same = Window.partitionBy("tid", "start", "stop").orderBy("ref")
    numbered = checked.filter("stop > start").withColumn("copy", F.row_number().over(same))  # equal regions stay apart
    return numbered.select(F.xxhash64("tid", "start", "stop", "copy").alias("rid"), "tid", "ref", "start", "stop")


def merged(regions: DataFrame) -> DataFrame:
    """Overlapping and touching regions of a contig become one; rid is its first position's."""
    by = Window.partitionBy("tid").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = regions.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    numbered = marked.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("tid", "ref", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return out.select(F.xxhash64("tid", "start").alias("rid"), "tid", "ref", "start", "stop")


def united(a: DataFrame, b: DataFrame, merge: bool = True) -> DataFrame:
    """Both sets of regions, merged or with every duplicate and overlap kept."""
    both = a.select(F.lit(0).alias("side"), "*").union(b.select(F.lit(1).alias("side"), "*"))
    both = both.select(F.xxhash64("side", "rid").alias("rid"), "tid", "ref", "start", "stop")
    return merged(both) if merge else both


def clip(spans: DataFrame, regions: DataFrame, keep: list[str]) -> DataFrame:
    """Interval join: (tid, start, stop, keep) with every region it overlaps, cut to that region.
    Both sides are dealt into bins and a pair is made in the bin of the later start only, so the join
    is an equi-join and makes each pair once. Bins are about as wide as regions are, so that most of what
    meets in a bin overlaps; what is much longer meets the other side in bins of BIN_BITS instead."""
    length = F.col("stop") - F.col("start")
    told = regions.agg(F.count(F.lit(1)), F.avg(length), F.max(length), F.sum(F.shiftright(length, BIN_BITS))).first()
    bits = min(max(int(told[1] or 0).bit_length(), MIN_BITS), BIN_BITS)
    most = LONG << bits
    # Numbers of bins tell their level: 0 for short ones of both sides, 1 for long regions, 2 for long spans with short regions.
    bins = lambda level, n: F.sequence(F.shiftright("start", n) + (level << LEVEL), F.shiftright(F.col("stop") - 1, n) + (level << LEVEL))
    wide = [bins(1, BIN_BITS)] if (told[2] or 0) > most else []
    s_bins = F.when(length <= most, F.concat(bins(0, bits), *wide)).otherwise(F.concat(bins(2, BIN_BITS), *wide))
    r_bins = F.when(length <= most, F.concat(bins(0, bits), bins(2, BIN_BITS))).otherwise(bins(1, BIN_BITS))
    s = spans.filter("start < stop").select("tid", F.col("start").alias("a"), F.col("stop").alias("z"), *keep, F.explode(s_bins).alias("bin"))
    r = regions.select("tid", "rid", "ref", "start", "stop", F.explode(r_bins).alias("bin"))
    r = F.broadcast(r) if told[0] <= SMALL and (told[3] or 0) <= SMALL else r
    at, number = F.greatest("a", "start"), F.col("bin").bitwiseAND(F.lit((1 << LEVEL) - 1))
    later = F.when(F.col("bin") < 1 << LEVEL, F.shiftright(at, bits)).otherwise(F.shiftright(at, BIN_BITS)) == number
    joined = s.join(r, ["tid", "bin"]).filter((F.col("a") < F.col("stop")) & (F.col("start") < F.col("z")) & later)
    return joined.select("rid", "tid", "ref", "start", "stop", at.alias("a"), F.least("z", "stop").alias("z"), *keep)


def clip_to_contigs(spans: DataFrame, contigs: DataFrame, keep: list[str]) -> DataFrame:
    """The same for one region a contig: an equi-join with the header's rows."""
    r = whole(contigs)
    s = spans.select("tid", F.col("start").alias("a"), F.col("stop").alias("z"), *keep)
    cut = s.join(small(r), "tid").select("rid", "tid", "ref", "start", "stop", F.greatest("a", "start").alias("a"), F.least("z", "stop").alias("z"), *keep)
    return cut.filter("a < z")
