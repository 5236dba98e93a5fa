"""CIGAR expressions: all built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the alignment format: operations that consume reference and query bases.
ON_REFERENCE = ["M", "D", "N", "=", "X"]
ON_QUERY = ["M", "I", "S", "=", "X"]
MATCHES = ["M", "=", "X"]


def parse(cigar: Column) -> Column:
    """'2M2I21M' to [{2, M}, {2, I}, {21, M}]; '*' and NULL to an empty array."""
    text = F.coalesce(cigar, F.lit(""))
    lengths = F.regexp_extract_all(text, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(lengths, ops, lambda n, op: F.struct(n.cast("int").alias("len"), op.alias("op")))


def consumed(cigar: Column, ops: list[str]) -> Column:
    """How many bases the operations in ``ops`` cover."""
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(ops)), F.lit(0).cast("bigint"), lambda n, x: n + x["len"])


def span(cigar: Column) -> Column:
    """Reference bases from the first to the last that the read touches, skips included."""
    return consumed(cigar, ON_REFERENCE)


def steps(cigar: Column) -> Column:
    """Each operation that lies on the reference: op, len, reference offset, query offset, and whether
    an insertion begins right after its last base (matches only). One pass with running offsets."""
    begun = F.transform(cigar, lambda x, i: F.struct(x["op"].alias("op"), x["len"].alias("len"), F.coalesce(F.get(cigar, i + 1)["op"] == "I", F.lit(False)).alias("before_ins")))
    kind = "array<struct<op:string,len:int,r:bigint,q:bigint,ins:boolean>>"

    def step(done: Column, x: Column) -> Column:
        one = F.struct(x["op"].alias("op"), x["len"].alias("len"), done["r"].alias("r"), done["q"].alias("q"), (x["op"].isin(MATCHES) & x["before_ins"]).alias("ins"))
        on_reference = x["op"].isin(ON_REFERENCE)
        return F.struct(
            (done["r"] + F.when(on_reference, x["len"]).otherwise(0)).alias("r"), (done["q"] + F.when(x["op"].isin(ON_QUERY), x["len"]).otherwise(0)).alias("q"),
            F.when(on_reference & (x["len"] > 0), F.array_append(done["out"], one)).otherwise(done["out"]).cast(kind).alias("out"),
        )

    zero, only = F.lit(0).cast("bigint"), F.get(cigar, F.lit(0))
    whole = F.array(F.struct(only["op"].alias("op"), only["len"].alias("len"), zero.alias("r"), zero.alias("q"), F.lit(False).alias("ins"))).cast(kind)
    start = F.struct(zero.alias("r"), zero.alias("q"), F.array().cast(kind).alias("out"))
    general = F.aggregate(begun, start, step, lambda done: done["out"])
    # Most reads are one match from end to end: they pass without the lambdas, which are interpreted.
    return F.when((F.size(cigar) == 1) & only["op"].isin(ON_REFERENCE) & (only["len"] > 0), whole).otherwise(general)


def with_blocks(reads: DataFrame, *keep: str, whole: Column | None = None) -> DataFrame:
    """A row (start, stop) for every aligned block: matches and deletions count, skips only advance.
    Reads for which ``whole`` holds are one block from start to end."""
    each = F.transform(F.filter(steps(F.col("cigar")), lambda x: x["op"] != "N"), lambda x: F.struct((F.col("pos") + x["r"]).alias("start"), (F.col("pos") + x["r"] + x["len"]).alias("stop")))
    if whole is None:
        return reads.select(*keep, F.inline(each))
    one = F.array(F.struct(F.col("pos").alias("start"), (F.col("pos") + span(F.col("cigar"))).alias("stop")))
    return reads.select(*keep, F.inline(F.when(whole, one).otherwise(each))).filter("start < stop")
