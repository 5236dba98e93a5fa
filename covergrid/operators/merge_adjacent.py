"""Merging adjacent intervals of equal depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions whose rows are compared in one window, as a power of two.
BIN_BITS = 20

# The names that each column may have in files.
ALIASES = {"REF": ("chrom",), "POS": ("chromStart",), "END": ("chromEnd",), "DEPTH": ("COV",)}


def named(rows: DataFrame) -> DataFrame:
    """REF, POS, END, DEPTH from any of their names; a missing END is POS + 1."""
    have = {c.lower(): c for c in rows.columns}
    col = {k: next((F.col(have[n.lower()]) for n in (k, *others) if n.lower() in have), None) for k, others in ALIASES.items()}
    for k in ("REF", "POS", "DEPTH"):
        if col[k] is None:
            raise ValueError(f"no column {k} or {' or '.join(ALIASES[k])}")
    pos = col["POS"].cast("bigint")
    end = pos + 1 if col["END"] is None else F.coalesce(col["END"].cast("bigint"), pos + 1)
    return rows.select(col["REF"].alias("REF"), pos.alias("POS"), end.alias("END"), col["DEPTH"].cast("bigint").alias("DEPTH"))


def merge_adjacent(rows: DataFrame) -> DataFrame:
    """Rows of a contig, by position: one that starts at or before the end of the row before it and has
    its depth continues it. A merged row ends where its last row ends.

    Whether a row continues depends on the row before alone, so rows are compared inside bins of
    positions, the last row of each bin is handed to the next bin, and so are the counts of breaks."""
    r = named(rows).withColumn("bin", F.shiftright("POS", BIN_BITS))
    key = F.struct("POS", "END", "DEPTH")
    across = Window.partitionBy("REF").orderBy("bin")
    inside = Window.partitionBy("REF", "bin").orderBy("POS", "END", "DEPTH")
    last = r.groupBy("REF", "bin").agg(F.max(key).alias("last")).select("REF", "bin", F.lag("last").over(across).alias("handed"))
    prev = F.coalesce(F.lag(key).over(inside), F.col("handed"))
    fresh = F.coalesce(~((prev["DEPTH"] == F.col("DEPTH")) & (prev["END"] >= F.col("POS"))), F.lit(True)).cast("int")
    marked = r.join(last, ["REF", "bin"]).withColumn("fresh", fresh).withColumn("nth", F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    breaks = marked.groupBy("REF", "bin").agg(F.sum("fresh").alias("breaks"))
    before = breaks.select("REF", "bin", F.coalesce(F.sum("breaks").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = marked.join(before, ["REF", "bin"]).withColumn("island", F.col("before") + F.col("nth"))
    out = numbered.groupBy("REF", "island").agg(F.min("POS").alias("POS"), F.max(key).alias("last"))
    return out.select("REF", "POS", F.col("last.END").alias("END"), F.col("last.DEPTH").alias("DEPTH"))
