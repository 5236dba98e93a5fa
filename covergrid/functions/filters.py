"""Read filters. A filter is a function from a DataFrame's columns to a boolean Column, so that it
stays inside generated code; any such function can be passed where a ReadFilter is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReadFilter:
    """Passes reads with all of include's flags, none of exclude's, and mapq of min_mapq or more."""

    include: int = 0
    exclude: int = 0
    min_mapq: int = 0

    def __call__(self) -> Column:
        flag = F.col("flag")
        lacking = F.bitwise_not(flag).bitwiseAND(F.lit(self.include))
        return (lacking == 0) & (flag.bitwiseAND(F.lit(self.exclude)) == 0) & (F.col("mapq") >= self.min_mapq)


def may_overlap_mate(span: Column) -> Column:
    """Whether a read could overlap its mate: paired, same contig, and half the template or the
    distance between the starts shorter than the read's span."""
    return (
        (F.col("flag").bitwiseAND(F.lit(1)) != 0) & (F.col("tid") == F.col("mate_tid"))
        & ((F.shiftright(F.abs("tlen"), 1) < span) | (F.abs(F.col("mate_pos") - F.col("pos")) < span))
    )
