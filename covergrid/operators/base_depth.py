"""Per-base depth: reads by position, then conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covergrid.functions import cigar
from covergrid.functions.bases import base
from covergrid.functions.filters import ReadFilter
from covergrid.operators import mates, pileup
from covergrid.operators import regions as R
from covergrid.schema import COUNTS, PIECE_BITS

UNMAPPED = 4
PIECE = 1 << PIECE_BITS


def aligned(reads: DataFrame, contigs: DataFrame, places: DataFrame | None, keep, mate_aware: bool, *more: str) -> DataFrame:
    """A row for every read and reference position that it spans inside a region. Reads are clipped to
    regions, then their operations, before these are expanded to positions."""
    carried = [*(["qname", "flag", "ord"] if mate_aware else []), *more]
    made = reads.filter(F.col("flag").bitwiseAND(F.lit(UNMAPPED)) == 0).withColumn("pass", keep())
    # As bytes, so that one of them is found without counting letters from the start.
    made = made.withColumn("seq", F.coalesce(F.col("seq"), F.lit("")).cast("binary"))
    kept = ["pos", "cigar", "pass", "mapq", "seq", "qual", *carried]
    # Whole reads meet regions, before anything is expanded.
    spans = made.select("tid", F.col("pos").alias("start"), (F.col("pos") + cigar.span(F.col("cigar"))).alias("stop"), *kept)
    met = R.clip_to_contigs(spans, contigs, kept) if places is None else R.clip(spans, places, kept)
    begin = F.col("pos") + F.col("r")
    rest = ["rid", "tid", "ref", "pass", "mapq", "seq", "qual", *carried]
    steps = met.select(*rest, "pos", "start", "stop", F.inline(cigar.steps(F.col("cigar")))).select(*rest, "op", "q", "ins", begin.alias("s"), (begin + F.col("len")).alias("e"), "start", "stop")
    cut = steps.withColumns({"a": F.greatest("s", "start"), "z": F.least("e", "stop")}).filter("a < z")
    at = cut.select(*rest, "op", "q", "ins", "s", "e", F.explode(F.sequence(F.col("a"), F.col("z") - 1)).alias("pos"))
    match = F.col("op").isin(cigar.MATCHES)
    here = F.col("q") + F.col("pos") - F.col("s")
    has_base = match & (F.octet_length("seq") > 0)
    return at.select(
        "rid", "tid", "ref", "pos", "pass", "mapq", *carried,
        F.when(match, F.lit("M")).otherwise(F.col("op")).alias("op"), has_base.alias("has_base"),
        F.when(has_base, base(F.substring("seq", (here + 1).cast("int"), F.lit(1)).cast("string"))).alias("base"),
        F.when(has_base, F.coalesce(F.get("qual", here.cast("int")), F.lit(255))).alias("bq"),
        (F.col("ins") & (F.col("pos") == F.col("e") - 1)).alias("ins"),
    )


def overlapping(reads: DataFrame) -> DataFrame:
    """reads with ``meets``: whether another read of the name spans a position of it on the contig."""
    by = Window.partitionBy("tid", "qname").orderBy("pos", "ord")
    end = F.col("pos") + cigar.span(F.col("cigar"))
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    meets = (F.coalesce(before, F.lit(-1)) > F.col("pos")) | (F.coalesce(F.lead("pos").over(by), F.lit(1 << 62)) < end)
    return reads.withColumn("meets", meets)


def clipped(reads: DataFrame, contigs: DataFrame, places: DataFrame | None, keep) -> DataFrame:
    """Reads with [a, z) for every disjoint place that they reach."""
    made = reads.filter(F.col("flag").bitwiseAND(F.lit(UNMAPPED)) == 0).select(
        "tid", F.col("pos").alias("start"), cigar.span(F.col("cigar")).alias("span"), "pos", "cigar", keep().alias("pass"), "mapq", F.coalesce(F.col("seq"), F.lit("")).cast("binary").alias("seq"), "qual",
        (F.col("flag").bitwiseAND(F.lit(mates.FIRST_IN_PAIR)) != 0).alias("first"), "ord", "qname",
    ).withColumn("stop", F.col("pos") + F.col("span"))
    kept = ["span", "pos", "cigar", "pass", "mapq", "seq", "qual", "first", "ord", "qname"]
    return R.clip_to_contigs(made, contigs, kept) if places is None else R.clip(made, places, kept)


def _capped(reads: DataFrame, contigs: DataFrame, places: DataFrame | None, keep, strategy: mates.Strategy | None, max_depth: int, min_base_quality: int | None) -> DataFrame:
    """Counts of the first max_depth reads at each position."""
    every = aligned(overlapping(reads) if strategy else reads.withColumn("meets", F.lit(False)), contigs, places, keep, True, "meets")
    first = Window.partitionBy("tid", "pos").orderBy("ord")
    every = every.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= max_depth).drop("nth")
    rows = every.filter("not meets").drop("qname", "flag", "ord").withColumns({"n": F.lit(1), "rec": F.lit(None).cast("string")})
    if strategy:
        rows = rows.unionByName(mates.resolve(every.filter("meets"), strategy).drop("qname", "flag", "ord"))
    return rows.groupBy("tid", "pos").agg(*_counts(min_base_quality))


def _counts(min_base_quality: int | None) -> list[Column]:
    ok, op, rec = F.col("pass"), F.col("op"), F.col("rec")
    masked = F.lit(False) if min_base_quality is None else F.coalesce(F.col("bq") < min_base_quality, F.lit(True))
    call = F.when(masked, "N").when(rec.isNotNull(), rec).when(~F.col("has_base"), "N").otherwise(F.col("base"))
    number = lambda c: F.count_if(c).cast("bigint")
    called = {b: number(ok & (op == "M") & (call == b)).alias(b) for b in "ACGTNRYSWKM"}
    return [
        number(ok & (op != "N")).alias("DEPTH"), *called.values(), number(ok & F.col("ins")).alias("INS"), number(ok & (op == "D")).alias("DEL"),
        number(ok & (op == "N")).alias("REF_SKIP"), number(~ok).alias("FAIL"), number(ok & (F.col("n") >= 2)).alias("COUNT_OF_MATE_RESOLUTIONS"),
        F.sum("n").cast("bigint").alias("raw"),
    ]


def reference_pieces(fasta: DataFrame) -> DataFrame:
    """(ref, seq) to (ref, piece, bases), PIECE bases a row, cut from bytes; pieces stay as they are."""
    if "piece" in fasta.columns:
        return fasta.select("ref", "piece", "bases")
    raw = fasta.select("ref", F.col("seq").cast("binary").alias("seq")).filter(F.octet_length("seq") > 0)
    pieces = raw.select("ref", "seq", F.explode(F.sequence(F.lit(0), F.shiftright(F.octet_length("seq") - 1, PIECE_BITS))).alias("piece"))
    return pieces.select("ref", F.col("piece").cast("bigint").alias("piece"), F.expr(f"cast(substring(seq, piece * {PIECE} + 1, {PIECE}) AS string)").alias("bases"))


def base_depth(
    reads: DataFrame, contigs: DataFrame, regions: DataFrame | None = None, *, mate_fix: bool = False, strategy: mates.Strategy | str = mates.Strategy.ORIGINAL,
    min_base_quality: int | None = None, keep_zeros: bool = False, zero_base: bool = False, max_depth: int = 100_000, fasta: DataFrame | None = None,
    keep=ReadFilter(), merge_regions: bool = True, cap_depth: bool = False,
) -> DataFrame:
    """A row for every position that any read spans (with keep_zeros: every position of every region).
    REF_BASE is there with fasta only, (ref, seq) or pieces (ref, piece, bases); NEAR_MAX_DEPTH looks at all
    reads, before filters and mates. With cap_depth, of more than max_depth reads at a position the first
    by their order in the file count."""
    strategy = mates.Strategy.parse(strategy) if isinstance(strategy, str) else strategy
    places = None if regions is None else R.merged(regions)
    if cap_depth:
        counts = _capped(reads, contigs, places, keep, strategy if mate_fix else None, max_depth, min_base_quality)
    else:
        counts = pileup.counts(clipped(reads, contigs, places, keep), strategy if mate_fix else None, min_base_quality)
    if regions is not None and not merge_regions:
        places = regions
    if keep_zeros or places is regions is not None:
        # What regions share is counted once: a position's counts come as often as regions hold it.
        held = (R.whole(contigs) if places is None else places).select("tid", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("pos"))
        if places is regions is not None:
            held = held.groupBy("tid", "pos").agg(F.count(F.lit(1)).cast("int").alias("times"))
        counts = held.join(counts, ["tid", "pos"], "left" if keep_zeros else "inner").fillna(0, [*COUNTS, "raw"])
        if places is regions is not None:
            counts = counts.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")
    counts = counts.join(R.small(contigs.select("tid", "ref")), "tid")
    near = F.col("raw") > max_depth - int(max_depth * 0.01)
    shift = 0 if zero_base else 1
    extra = []
    if fasta is not None:
        counts = counts.withColumn("piece", F.shiftright("pos", PIECE_BITS)).join(reference_pieces(fasta), ["ref", "piece"], "left")
        letter = F.substring(F.col("bases").cast("binary"), (F.col("pos") % PIECE + 1).cast("int"), F.lit(1)).cast("string")
        missing = F.raise_error(F.concat(F.lit("no reference base at "), "ref", F.lit(":"), F.col("pos").cast("string")))
        extra = [F.when(F.coalesce(F.length(letter), F.lit(0)) == 1, letter).otherwise(missing.cast("string")).alias("REF_BASE")]
    return counts.select(F.col("ref").alias("REF"), (F.col("pos") + shift).alias("POS"), *extra, *COUNTS, near.alias("NEAR_MAX_DEPTH"))
