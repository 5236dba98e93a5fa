"""What the operators of this package share: word rules, hold-out folds, shared storage."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What lies between the contracts' words, as Java patterns: all of ASCII but a-z and 0-9, or white
#: space. Splitting at these is several times as fast as extracting the words by the complement.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Most bytes that any operator here broadcasts; larger sides are taken block by block.
BROADCAST_BYTES = 32 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` does just that where a text is pure ASCII, and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def alnum_words(text: Column) -> Column:
    """The lower-cased words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def fold(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or in local mode a
    temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="covergrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/covergrid/{spark.sparkContext.applicationId}"


def until_exit(spark: SparkSession, path: str) -> None:
    """Has the folder deleted when the application ends: until then results may still read it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends there, and lost executors
    cost no more than the tasks that ran on them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that hold more than one part in CROWDED of all rows are joined apart, by a broadcast; there are fewer than CROWDED.
CROWDED, LEAST_CROWD = 1000, 100


def meet(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with per_key, which has one row for each value of the column key, and in n how many of rows
    have that value, at most total together. Rows of crowded keys stay where they are: fewer than CROWDED
    such keys can exist, so theirs are broadcast; all others meet in an ordinary join. Keys are not null."""
    most = max(LEAST_CROWD, total // CROWDED)
    crowded = F.broadcast(per_key.filter(F.col("n") > most))
    apart = rows.join(crowded.select(key), key, "left_anti").join(per_key.filter(F.col("n") <= most), key)
    return rows.join(crowded, key).drop("n").unionByName(apart.drop("n"))
