"""Alignments derived from the table lineitem: one SELECT that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergrid.functions import cigar

LENGTH = 200_000
CONTIG_NAMES = ["chr1", "chr2", "chr3"]

# Every line is a read. An order's lines are named by threes, so a name has one to three reads: a pair, and
# a secondary alignment (flag 256) of its first. Flag 64 is on the first and the secondary.
READS_SQL = f"""
SELECT concat('o', k, '_', g) AS qname, CASE i WHEN 0 THEN 67 WHEN 1 THEN 147 ELSE 323 END + CASE WHEN rf = 'R' AND ls = 'O' THEN 512 ELSE 0 END AS flag,
       CAST(k % 3 AS INT) AS tid, concat('chr', k % 3 + 1) AS ref, (k * 7 + g * 1000) % {LENGTH} + i * 10 AS pos, CAST(qty AS INT) AS mapq,
       CASE ln % 4 WHEN 0 THEN '25M' WHEN 1 THEN '2M2I21M' WHEN 2 THEN '2M5D23M' ELSE '3M5N22M' END AS cigar_text,
       CAST(k % 3 AS INT) AS mate_tid, (k * 7 + g * 1000) % {LENGTH} + CASE WHEN i = 0 AND n > g * 3 + 1 THEN 10 ELSE 0 END AS mate_pos,
       CASE WHEN k % 5 = 0 THEN 90 ELSE 35 END AS tlen,
       CASE WHEN k % 11 = 0 THEN '' ELSE translate(substr(md5(concat('s', k, '_', rn)), 1, 25), '0123456789abcdef', 'ACGTACGTACGTACGN') END AS seq,
       CASE WHEN k % 11 = 0 THEN '' ELSE substr(md5(concat('q', k, '_', rn)), 1, 25) END AS qual_text, k * 8 + rn AS ord
FROM (SELECT *, CAST((rn - 1 - (rn - 1) % 3) / 3 AS INT) AS g, (rn - 1) % 3 AS i
      FROM (SELECT l_orderkey AS k, l_linenumber AS ln, l_quantity AS qty, l_returnflag AS rf, l_linestatus AS ls,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
                   count(*) OVER (PARTITION BY l_orderkey) AS n
            FROM lineitem))
"""


def contigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r, LENGTH) for i, r in enumerate(CONTIG_NAMES)], "tid int, ref string, length bigint")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    made = spark.sql(READS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    digit = F.transform(F.filter(F.split("qual_text", ""), lambda c: c != ""), lambda c: (F.instr(F.lit("0123456789abcdef"), c) - 1) * 3)
    return made.select(
        "qname", F.col("flag").cast("int").alias("flag"), "tid", "ref", F.col("pos").cast("bigint").alias("pos"), "mapq", cigar.parse(F.col("cigar_text")).alias("cigar"),
        "mate_tid", F.col("mate_pos").cast("bigint").alias("mate_pos"), F.col("tlen").cast("bigint").alias("tlen"), "seq", digit.alias("qual"), F.col("ord").cast("bigint").alias("ord"),
    )


# Regions derived from the table supplier: overlapping, touching and repeated ones among them.
INTERVALS_SQL = f"SELECT concat('chr', s_suppkey % 3 + 1) AS ref, s_suppkey * 1730 % {LENGTH - 300} AS start, s_suppkey * 1730 % {LENGTH - 300} + s_nationkey * 20 AS stop FROM supplier"
SITES_SQL = f"SELECT concat('chr', c_custkey % 3 + 1) AS ref, c_custkey * 37 % {LENGTH} AS start, c_custkey * 37 % {LENGTH} + 1 AS stop FROM customer"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql(INTERVALS_SQL.replace("FROM supplier", "FROM {supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    return made.select("ref", F.col("start").cast("bigint"), F.col("stop").cast("bigint"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql(SITES_SQL.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return made.select("ref", F.col("start").cast("bigint"), F.col("stop").cast("bigint"))


def fasta(spark: SparkSession) -> DataFrame:
    """A sequence for each contig that SQL can compute: letter p is the (p * p + tid) % 7 th of ACGTacN."""
    return contigs(spark).select("ref", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda p: F.substring(F.lit("ACGTacN"), ((p.cast("bigint") * p + F.col("tid")) % 7 + 1).cast("int"), F.lit(1))), "").alias("seq"))
