"""Text sources: SAM, BED, VCF, FASTA and interval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covergrid.functions import cigar
from covergrid.operators.regions import small
from covergrid.schema import PIECE_BITS

GZIPPED = (".gz", ".gzip", ".bgzf")


def is_gzipped(path: str) -> bool:
    """By the file's extension. Block-gzipped files are ordinary gzip files of many members."""
    return path.endswith(GZIPPED)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a file, unpacked where its name says it is gzipped."""
    if is_gzipped(path) and not path.endswith(".gz"):  # names that Hadoop's codecs don't know
        raw = spark.read.format("binaryFile").load(path).select("content")
        return raw.mapInArrow(_gunzip_lines, "value string")
    return spark.read.text(path)


def _gunzip_lines(batches):
    import gzip

    import pyarrow as pa

    for b in batches:
        for content in b.column(0):
            for part in _groups(gzip.decompress(content.as_py()).decode().splitlines(), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["value"])


def _groups(items: list, n: int):
    for at in range(0, len(items), n):
        yield items[at : at + n]


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """The @SQ lines of a SAM header, in order. A header is small: it is numbered on the driver."""
    rows = lines(spark, path).filter(F.col("value").startswith("@SQ\t")).select(
        F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("ref"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("length")
    ).collect()
    return spark.createDataFrame([(i, r.ref, r.length) for i, r in enumerate(rows)], "tid int, ref string, length bigint")


def sam_reads(spark: SparkSession, path: str) -> DataFrame:
    """The alignment lines of a SAM file as READS."""
    aligned = ~F.col("value").startswith("@") & (F.col("value") != "")
    order = F.monotonically_increasing_id().alias("ord")
    # Other lines are NULL to every later expression: Spark may evaluate casts before it filters.
    f = lines(spark, path).filter(aligned).select(F.split(F.when(aligned, F.col("value")), "\t").alias("f"), order)
    i = lambda n: F.get("f", F.lit(n))
    text = f.select(
        i(0).alias("qname"), i(1).cast("int").alias("flag"), i(2).alias("ref"), (i(3).cast("bigint") - 1).alias("pos"), i(4).cast("int").alias("mapq"),
        cigar.parse(i(5)).alias("cigar"), F.when(i(6) == "=", i(2)).otherwise(i(6)).alias("mate_ref"), (i(7).cast("bigint") - 1).alias("mate_pos"),
        i(8).cast("bigint").alias("tlen"), F.when(i(9) != "*", i(9)).alias("seq"), i(10).alias("q"), "ord",
    )
    none = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda _: F.lit(255))
    phred = F.transform(F.filter(F.split("q", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    header = sam_contigs(spark, path)
    contigs = small(header.select("tid", "ref"))
    mates = small(header.select(F.col("tid").alias("mate_tid"), F.col("ref").alias("mate_ref")))
    joined = text.join(contigs, "ref", "left").join(mates, "mate_ref", "left")
    return joined.select(
        "qname", "flag", F.coalesce("tid", F.lit(-1)).alias("tid"), "ref", "pos", "mapq", "cigar", F.coalesce("mate_tid", F.lit(-1)).alias("mate_tid"), "mate_pos", "tlen", "seq",
        F.when(F.coalesce(F.length("seq"), F.lit(0)) == 0, F.array().cast("array<int>")).when(F.col("q") == "*", none).otherwise(phred).alias("qual"), "ord",
    )


def bed_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(ref, start, stop) of a BED file; comment, track and browser lines are passed over."""
    f = lines(spark, path).filter(~F.col("value").rlike(r"^(#|track\b|browser\b|\s*$)")).select(F.split("value", "\t").alias("f"))
    return f.select(F.get("f", F.lit(0)).alias("ref"), F.get("f", F.lit(1)).cast("bigint").alias("start"), F.get("f", F.lit(2)).cast("bigint").alias("stop"))


def vcf_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(ref, start, stop): the one position of each record of a VCF file."""
    f = lines(spark, path).filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t", 3).alias("f"))
    pos = F.get("f", F.lit(1)).cast("bigint")
    return f.select(F.get("f", F.lit(0)).alias("ref"), (pos - 1).alias("start"), pos.alias("stop"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ref, seq) of a FASTA file, letters as they are. Records are split off by Spark's reader, so one
    record is one row: as long as the longest contig."""
    records = spark.read.option("lineSep", ">").text(path) if not is_gzipped(path) or path.endswith(".gz") else _whole(spark, path)
    parts = records.filter(F.trim("value") != "").select(F.split("value", "\n", 2).alias("p"))
    return parts.select(F.regexp_extract(F.get("p", F.lit(0)), r"^(\S+)", 1).alias("ref"), F.regexp_replace(F.get("p", F.lit(1)), r"\s", "").alias("seq"))


def fasta_pieces(spark: SparkSession, path: str, bits: int = PIECE_BITS) -> DataFrame:
    """(ref, piece, bases) of a FASTA file: each contig in pieces of 2 ** bits letters. Lines are placed by
    running sums within the reader's partitions, and those by what the partitions before hold."""
    line = lines(spark, path).select(F.rtrim("value").alias("value"), F.monotonically_increasing_id().alias("id")).filter("value <> ''")
    named = F.col("value").startswith(">")
    line = line.select(F.shiftright("id", 33).alias("part"), "id", F.when(named, F.regexp_extract("value", r"^>(\S*)", 1)).alias("name"), F.when(~named, F.col("value")).alias("bases"))
    line = line.withColumn("n", F.coalesce(F.length("bases"), F.lit(0)).cast("bigint"))
    upto = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("upto", F.sum("n").over(upto)).withColumn("begin", F.last(F.when(F.col("name").isNotNull(), F.struct("name", F.col("upto").alias("at"))), ignorenulls=True).over(upto))
    part = line.groupBy("part").agg(F.max_by("begin", "id").alias("last"), F.sum("n").alias("n"))
    # A row for each of the reader's partitions.
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("tail", F.col("n") - F.coalesce("last.at", F.lit(0).cast("bigint"))).withColumn("of", F.count("last").over(whole))
    part = part.withColumns({"name": F.last("last.name", ignorenulls=True).over(whole), "length": F.sum("tail").over(Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))})
    one = Window.orderBy("part")
    before = small(part.select("part", F.lag("name").over(one).alias("open"), F.lag("length").over(one).alias("had")))
    placed = line.filter("bases is not null").join(before, "part").select(
        F.coalesce("begin.name", "open").alias("ref"), F.col("bases").cast("binary").alias("bases"), "n",
        (F.col("upto") - F.col("n") - F.coalesce("begin.at", F.lit(0)) + F.when(F.col("begin").isNull(), F.coalesce("had", F.lit(0))).otherwise(0)).alias("at"),
    )
    cut = placed.filter("ref is not null").select("ref", "bases", "at", "n", F.explode(F.sequence(F.shiftright("at", bits), F.shiftright(F.col("at") + F.col("n") - 1, bits))).alias("piece"))
    first = F.greatest("at", F.shiftleft("piece", bits))
    cut = cut.select("ref", "piece", first.alias("first"), F.substring("bases", (first - F.col("at") + 1).cast("int"), (F.least(F.col("at") + F.col("n"), F.shiftleft(F.col("piece") + 1, bits)) - first).cast("int")).cast("string").alias("bases"))
    return cut.groupBy("ref", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "bases"))), lambda x: x["bases"]), "").alias("bases"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    joined = lines(spark, path).agg(F.array_join(F.collect_list("value"), "\n").alias("text"))
    return joined.select(F.explode(F.split("text", ">")).alias("value"))


def intervals(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A tab-separated table for merge_adjacent: named by its header, or as REF, POS, END, DEPTH (three
    columns: REF, POS, DEPTH; five: BED columns)."""
    if is_gzipped(path) and not path.endswith(".gz"):
        table = spark.read.csv(lines(spark, path).rdd.map(lambda r: r.value), sep="\t", header=header)
    else:
        table = spark.read.csv(path, sep="\t", header=header)
    if header:
        return table
    names = {3: ["REF", "POS", "DEPTH"], 4: ["REF", "POS", "END", "DEPTH"], 5: ["chrom", "chromStart", "chromEnd", "name", "COV"]}
    if len(table.columns) not in names:
        raise ValueError(f"{path}: {len(table.columns)} columns; there should be 3, 4 or 5")
    return table.toDF(*names[len(table.columns)])
