"""Mate resolution: of the reads of one name at one position, which counts, and as what base."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covergrid.functions.bases import either_or

FIRST_IN_PAIR = 64


class Strategy(Enum):
    """Which keys order the mates (best first), whether first-in-pair breaks ties, and what base a tie,
    or for the last two every pair, is given."""

    ORIGINAL = ((), True, None)
    BASE_QUAL_MAP_QUAL_FIRST_IN_PAIR = (("bq", "mapq"), True, None)
    BASE_QUAL_MAP_QUAL_IUPAC = (("bq", "mapq"), False, "iupac")
    BASE_QUAL_MAP_QUAL_N = (("bq", "mapq"), False, "n")
    MAP_QUAL_BASE_QUAL_FIRST_IN_PAIR = (("mapq", "bq"), True, None)
    MAP_QUAL_BASE_QUAL_IUPAC = (("mapq", "bq"), False, "iupac")
    MAP_QUAL_BASE_QUAL_N = (("mapq", "bq"), False, "n")
    IUPAC = ((), False, "iupac")
    N = ((), False, "n")

    def __init__(self, keys: tuple[str, ...], first: bool, tie: str | None):
        self.keys, self.first, self.tie = keys, first, tie

    @classmethod
    def parse(cls, text: str) -> Strategy:
        """By name in any case, with or without separators."""
        plain = lambda s: s.replace("_", "").replace("-", "").lower()
        for s in cls:
            if plain(s.name) == plain(text):
                return s
        raise ValueError(f"no such strategy: {text}; there are {', '.join(s.name.lower() for s in cls)}")


def _keys(strategy: Strategy, paired: Column) -> list[Column]:
    """Sort keys after the filter's verdict. Where a mate has no base there (deletions, skips, no
    sequence) every strategy orders as ORIGINAL does."""
    first = (F.col("flag").bitwiseAND(F.lit(FIRST_IN_PAIR)) != 0).cast("int")
    fallback = [F.col("mapq"), first]
    if strategy is Strategy.ORIGINAL:
        return fallback
    own = [F.col(k) for k in strategy.keys] + ([first] if strategy.first else [])
    null = F.lit(None).cast("int")
    out = []
    for i in range(max(len(own), len(fallback))):
        mine, other = (own[i] if i < len(own) else null), (fallback[i] if i < len(fallback) else null)
        out.append(F.when(paired, mine).otherwise(other))
    return out


def resolve(aligned: DataFrame, strategy: Strategy) -> DataFrame:
    """Of each (rid, pos, qname) one row stays, with n (reads there), rec (the base recommended, or null)."""
    group = Window.partitionBy("rid", "pos", "qname")
    paired = F.col("paired")
    counted = aligned.withColumns({"n": F.count(F.lit(1)).over(group), "paired": F.min("has_base").over(group)})
    order = group.orderBy(F.col("pass").desc(), *(k.desc() for k in _keys(strategy, paired)), F.col("ord").asc())
    nxt = lambda c: F.lead(c).over(order)
    ranked = counted.withColumns({"rank": F.row_number().over(order), "base2": nxt("base"), "bq2": nxt("bq"), "mapq2": nxt("mapq"), "pass2": nxt("pass")})
    if strategy.tie is None:
        rec = F.lit(None).cast("string")
    else:
        met = (F.col("n") >= 2) & F.col("pass") & F.col("pass2") & paired
        if strategy.keys:
            met &= (F.col("bq") == F.col("bq2")) & (F.col("mapq") == F.col("mapq2"))
        rec = F.when(met, either_or(F.col("base"), F.col("base2"), strategy.tie == "n"))
    return ranked.filter("rank = 1").withColumn("rec", rec).drop("rank", "base2", "bq2", "mapq2", "pass2", "paired")
