"""Base letters and their combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ambiguity code of two different bases.
AMBIGUITY = {"AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M"}


def base(letter: Column) -> Column:
    """A, C, G, T (U too) in either case; anything else is N."""
    up = F.upper(letter)
    return F.when(up == "U", "T").when(up.isin("A", "C", "G", "T"), up).otherwise("N")


def either_or(a: Column, b: Column, ambiguous_is_n: bool = False) -> Column:
    """The base that stands for a or b: the same one, their ambiguity code, else N."""
    pair = F.concat(F.least(a, b), F.greatest(a, b))
    out = F.when((a == b) & (a != "N"), a)
    if not ambiguous_is_n:
        for two, code in AMBIGUITY.items():
            out = out.when(pair == two, code)
    return out.otherwise("N")
