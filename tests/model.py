"""Reads for tests, and plain-Python models of what the engine computes."""

from __future__ import annotations

import re
from collections import defaultdict

from covergrid.schema import CONTIGS, READS


def run_length(text: str) -> str:
    """'A2 G3' to 'AAGGG'."""
    return "".join(x[0] * int(x[1:]) for x in text.split())


def ops(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def read(tids, qname, flag, ref, pos1, mapq, cigar, mate1, tlen, seq, qual=2, ord=0):
    seq = run_length(seq) if seq != "*" else None
    return (qname, flag, tids[ref], ref, pos1 - 1, mapq, ops(cigar), tids[ref], mate1 - 1, tlen, seq, [qual] * len(seq or ""), ord)


def frames(spark, contigs: dict[str, int], rows: list):
    tids = {c: i for i, c in enumerate(contigs)}
    made = [read(tids, *r, ord=i) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, READS), spark.createDataFrame([(tids[c], c, n) for c, n in contigs.items()], CONTIGS)


def depth(rows: list, contigs: dict[str, int], exclude: int = 0, fast: bool = False, mate_fix: bool = False) -> dict[tuple[str, int], int]:
    """(contig, position) to depth; positions without depth are left out."""
    seen, out = set(), defaultdict(int)
    for qname, flag, ref, pos1, _, cigar, mate1, tlen, *_ in rows:
        if flag & exclude:
            continue
        at, here = pos1 - 1, set()
        for n, op in ops(cigar):
            if op in "M=XDN":
                if fast or op != "N":
                    here |= set(range(at, at + n))
                at += n
        span = at - (pos1 - 1)
        pairs = mate_fix and flag & 1 and (abs(tlen) // 2 < span or abs(mate1 - pos1) < span)
        for p in here:
            if p < contigs[ref] and not (pairs and (ref, qname, p) in seen):
                out[ref, p] += 1
            if pairs:
                seen.add((ref, qname, p))
    return dict(out)
