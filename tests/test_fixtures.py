"""Reads and the rows that they must give. The tables up to MATES are fixed values: records and depths that any
engine of this behaviour must reproduce."""

import re

import pytest

from covergrid.functions.filters import ReadFilter
from covergrid.operators.base_depth import base_depth
from covergrid.operators.mates import Strategy
from covergrid.operators.merge_adjacent import merge_adjacent
from covergrid.operators.only_depth import only_depth
from tests.model import depth, frames

CHR1 = [
    ("ONE", 67, "chr1", 1, 40, "25M", 50, 75, "A25"), ("TWO", 67, "chr1", 5, 40, "25M", 55, 75, "A25"), ("THREE", 67, "chr1", 10, 40, "25M", 60, 75, "A25"),
    ("FOUR", 67, "chr1", 15, 40, "25M", 65, 75, "A25"), ("FIVE", 67, "chr1", 20, 40, "25M", 70, 75, "A25"), ("ONE", 147, "chr1", 50, 40, "25M", 1, 75, "T25"),
    ("TWO", 147, "chr1", 55, 40, "25M", 5, 75, "G25"), ("THREE", 147, "chr1", 60, 40, "25M", 10, 75, "C25"), ("FOUR", 147, "chr1", 65, 40, "25M", 15, 75, "N25"),
    ("FIVE", 147, "chr1", 70, 40, "25M", 20, 75, "A25"),
]


def chr2(five_tlen):
    return [
        ("ONE", 67, "chr2", 1, 40, "2M2I21M", 50, 75, "A2 G3 A20"), ("TWO", 67, "chr2", 5, 40, "2M5D23M", 55, 75, "A25"), ("THREE", 67, "chr2", 10, 40, "3M5N22M", 60, 75, "A25"),
        ("FOUR", 67, "chr2", 15, 40, "25M", 65, 75, "A1 T1 A23"), ("FIVE", 67, "chr2", 20, 40, "25M", 35, 40, "A25"), ("FIVE", 147, "chr2", 35, 40, "25M", 20, five_tlen, "A25"),
        ("ONE", 147, "chr2", 50, 40, "25M", 1, 75, "A21 Y1 A3"), ("TWO", 147, "chr2", 55, 40, "25M", 5, 75, "A25"), ("THREE", 147, "chr2", 60, 40, "25M", 10, 75, "A25"),
        ("FOUR", 659, "chr2", 65, 40, "25M", 15, 75, "A25"),
    ]


FIXTURE_A = CHR1 + chr2(40)
FIXTURE_B = [
    *CHR1, ("FIVE", 147, "chr1", 999976, 40, "25M", 1000026, 75, "A25"), ("FIVE", 147, "chr1", 1000026, 40, "25M", 999976, 75, "A25"),
    *chr2(-40), ("SIX", 67, "chr2", 120, 40, "25M", 120, 40, "A25"), ("SIX", 147, "chr2", 120, 40, "25M", 120, -40, "A25"),
    ("SEVEN", 67, "chr2", 160, 40, "50M", 150, 50, "A50"), ("SEVEN", 147, "chr2", 175, 40, "25M", 175, -50, "A25"),
    ("ONE", 67, "chr3", 1, 40, "2M2000000N23M", 50, 75, "A25"), ("TWO", 67, "chr3", 5, 40, "25M", 55, 75, "A25"), ("THREE", 67, "chr3", 10, 40, "23M2000000N2M", 60, 75, "A25"),
    ("FOUR", 67, "chr3", 15, 40, "25M", 65, 75, "A25"), ("FIVE", 67, "chr3", 20, 40, "25M", 70, 75, "A25"), ("ONE", 147, "chr3", 50, 40, "25M", 1, 75, "T25"),
    ("TWO", 147, "chr3", 55, 40, "25M", 5, 75, "G25"), ("THREE", 147, "chr3", 60, 40, "25M", 10, 75, "C25"), ("FOUR", 147, "chr3", 65, 40, "25M", 15, 75, "N25"), ("FIVE", 147, "chr3", 70, 40, "25M", 20, 75, "A25"),
]
KEEP = ReadFilter(exclude=512)
COLUMNS = ["DEPTH", "A", "C", "G", "T", "N", "INS", "DEL", "REF_SKIP", "FAIL"]

# first-last position, then COLUMNS
CHR1_COUNTS = """1-4 1 1 0 0 0 0 0 0 0 0; 5-9 2 2 0 0 0 0 0 0 0 0; 10-14 3 3 0 0 0 0 0 0 0 0; 15-19 4 4 0 0 0 0 0 0 0 0; 20-25 5 5 0 0 0 0 0 0 0 0;
26-29 4 4 0 0 0 0 0 0 0 0; 30-34 3 3 0 0 0 0 0 0 0 0; 35-39 2 2 0 0 0 0 0 0 0 0; 40-44 1 1 0 0 0 0 0 0 0 0; 50-54 1 0 0 0 1 0 0 0 0 0; 55-59 2 0 0 1 1 0 0 0 0 0;
60-64 3 0 1 1 1 0 0 0 0 0; 65-69 4 0 1 1 1 1 0 0 0 0; 70-74 5 1 1 1 1 1 0 0 0 0; 75-79 4 1 1 1 0 1 0 0 0 0; 80-84 3 1 1 0 0 1 0 0 0 0; 85-89 2 1 0 0 0 1 0 0 0 0; 90-94 1 1 0 0 0 0 0 0 0 0"""
CHR2_HEAD = """1-1 1 1 0 0 0 0 0 0 0 0; 2-2 1 1 0 0 0 0 1 0 0 0; 3-3 1 0 0 1 0 0 0 0 0 0; 4-4 1 1 0 0 0 0 0 0 0 0; 5-6 2 2 0 0 0 0 0 0 0 0; 7-9 2 1 0 0 0 0 0 1 0 0;
10-11 3 2 0 0 0 0 0 1 0 0; 12-12 3 3 0 0 0 0 0 0 0 0; 13-14 2 2 0 0 0 0 0 0 1 0; 15-15 3 3 0 0 0 0 0 0 1 0; 16-16 3 2 0 0 1 0 0 0 1 0; 17-17 3 3 0 0 0 0 0 0 1 0;
18-19 4 4 0 0 0 0 0 0 0 0; 20-23 5 5 0 0 0 0 0 0 0 0"""
CHR2_TAIL = """45-49 1 1 0 0 0 0 0 0 0 0; 50-54 2 2 0 0 0 0 0 0 0 0; 55-64 3 3 0 0 0 0 0 0 0 0; 65-70 3 3 0 0 0 0 0 0 0 1; 71-71 3 2 0 0 0 1 0 0 0 1; 72-74 3 3 0 0 0 0 0 0 0 1;
75-79 2 2 0 0 0 0 0 0 0 1; 80-84 1 1 0 0 0 0 0 0 0 1; 85-89 0 0 0 0 0 0 0 0 0 1"""
CHR2_COUNTS = CHR2_HEAD + "; 24-39 4 4 0 0 0 0 0 0 0 0; 40-44 2 2 0 0 0 0 0 0 0 0; " + CHR2_TAIL
CHR2_MATE_FIX = CHR2_HEAD + "; 24-34 4 4 0 0 0 0 0 0 0 0; 35-39 3 3 0 0 0 0 0 0 0 0; 40-44 1 1 0 0 0 0 0 0 0 0; " + CHR2_TAIL


def expanded(text):
    out = {}
    for row in text.split(";"):
        span, *values = row.split()
        a, z = map(int, span.split("-"))
        out |= {p: tuple(map(int, values)) for p in range(a, z + 1)}
    return out


def counts(df, ref):
    return {r.POS: tuple(r[c] for c in COLUMNS) for r in df.filter(f"REF = '{ref}'").collect()}


@pytest.fixture(scope="module")
def a(spark):
    return frames(spark, {"chr1": 100, "chr2": 100}, FIXTURE_A)


def test_base_depth(a):
    got = base_depth(*a, keep=KEEP, max_depth=500_000).cache()
    assert counts(got, "chr1") == expanded(CHR1_COUNTS)
    assert counts(got, "chr2") == expanded(CHR2_COUNTS)
    assert not any(r.NEAR_MAX_DEPTH or r.COUNT_OF_MATE_RESOLUTIONS for r in got.collect())


def test_base_depth_mate_fix(a):
    got = base_depth(*a, keep=KEEP, mate_fix=True).cache()
    assert counts(got, "chr1") == expanded(CHR1_COUNTS)
    assert counts(got, "chr2") == expanded(CHR2_MATE_FIX)
    assert {r.POS for r in got.collect() if r.COUNT_OF_MATE_RESOLUTIONS} == set(range(35, 45))


@pytest.mark.parametrize("threshold, masked", [(1, False), (3, True)])
def test_base_quality(a, threshold, masked):
    for r in base_depth(*a, keep=KEEP, min_base_quality=threshold).collect():
        assert r.DEPTH == r.A + r.C + r.G + r["T"] + r.N + r.R + r.Y + r.S + r.W + r.K + r.M + r.DEL
        if masked:
            assert r.N == r.DEPTH - r.DEL


def test_keep_zeros_and_zero_base(a):
    got = base_depth(*a, keep=KEEP, keep_zeros=True, zero_base=True).collect()
    assert len(got) == 200 and {r.POS for r in got} == set(range(100))
    assert sum(r.DEPTH for r in got) == sum(r.DEPTH for r in base_depth(*a, keep=KEEP).collect())


RUNS = {
    "chr1": "[0,4)=1; [4,9)=2; [9,14)=3; [14,19)=4; [19,25)=5; [25,29)=4; [29,34)=3; [34,39)=2; [39,44)=1; [44,49)=0; [49,54)=1; [54,59)=2; [59,64)=3; [64,69)=4; [69,74)=5; [74,79)=4; [79,84)=3; [84,89)=2; [89,94)=1; [94,999975)=0; [999975,1000000)=1; [1000000,1000025)=0; [1000025,1000050)=1; [1000050,2000000)=0; [2000000,3000000)=0",
    "chr2": "[0,4)=1; [4,9)=2; [9,12)=3; [12,14)=2; [14,17)=3; [17,19)=4; [19,23)=5; [23,39)=4; [39,44)=2; [44,49)=1; [49,54)=2; [54,74)=3; [74,79)=2; [79,84)=1; [84,119)=0; [119,144)=2; [144,159)=0; [159,174)=1; [174,199)=2; [199,209)=1; [209,1000000)=0; [1000000,2000000)=0; [2000000,3000000)=0",
    "chr3": "[0,2)=1; [2,4)=0; [4,9)=1; [9,14)=2; [14,19)=3; [19,29)=4; [29,32)=3; [32,39)=2; [39,44)=1; [44,49)=0; [49,54)=1; [54,59)=2; [59,64)=3; [64,69)=4; [69,74)=5; [74,79)=4; [79,84)=3; [84,89)=2; [89,94)=1; [94,1000000)=0; [1000000,2000000)=0; [2000000,2000002)=0; [2000002,2000025)=1; [2000025,2000032)=0; [2000032,2000034)=1; [2000034,3000000)=0",
}
FAST_CHR3 = "[0,4)=1; [4,9)=2; [9,14)=3; [14,19)=4; [19,29)=5; [29,39)=4; [39,44)=3; [44,49)=2; [49,54)=3; [54,59)=4; [59,64)=5; [64,69)=6; [69,74)=7; [74,79)=6; [79,84)=5; [84,89)=4; [89,94)=3; [94,1000000)=2; [1000000,2000000)=2; [2000000,2000025)=2; [2000025,2000034)=1; [2000034,3000000)=0"
MATE_CHR2 = "[0,4)=1; [4,9)=2; [9,12)=3; [12,14)=2; [14,17)=3; [17,19)=4; [19,23)=5; [23,34)=4; [34,39)=3; [39,49)=1; [49,54)=2; [54,74)=3; [74,79)=2; [79,84)=1; [84,119)=0; [119,144)=1; [144,159)=0; [159,209)=1; [209,1000000)=0; [1000000,2000000)=0; [2000000,3000000)=0"
LENGTHS = {"chr1": 3_000_000, "chr2": 3_000_000, "chr3": 3_000_000}


@pytest.fixture(scope="module")
def b(spark):
    return frames(spark, LENGTHS, FIXTURE_B)


def runs(df, ref):
    return "; ".join(f"[{r.POS},{r.END})={r.DEPTH}" for r in sorted((r for r in df if r.REF == ref), key=lambda r: r.POS))


@pytest.mark.parametrize("options, changed", [({}, {}), ({"fast": True}, {"chr3": FAST_CHR3}), ({"mate_fix": True}, {"chr2": MATE_CHR2})])
def test_only_depth_chunked(b, options, changed):
    got = only_depth(*b, keep=KEEP, zero_base=True, chunksize=1_000_000, **options).collect()
    for ref, text in (RUNS | changed).items():
        if ref != "chr2" or "fast" not in options:
            assert runs(got, ref) == text


def joined(text):
    """Without the breaks between runs of equal depth."""
    out = []
    for a, z, d in re.findall(r"\[(\d+),(\d+)\)=(\d+)", text):
        if out and out[-1][2] == d:
            out[-1][1] = z
        else:
            out.append([a, z, d])
    return "; ".join(f"[{a},{z})={d}" for a, z, d in out)


def test_only_depth_has_no_breaks_without_chunks(b):
    got = only_depth(*b, keep=KEEP, zero_base=True).collect()
    for ref, text in RUNS.items():
        assert runs(got, ref) == joined(text)


@pytest.mark.parametrize("fast", [False, True])
@pytest.mark.parametrize("mate_fix", [False, True])
def test_only_depth_equals_the_model(spark, b, fast, mate_fix):
    rows = [r for r in FIXTURE_B if r[5] in ("25M", "50M", "2M2I21M", "2M5D23M", "3M5N22M")]
    reads, contigs = frames(spark, LENGTHS, rows)
    got = only_depth(reads, contigs, keep=KEEP, zero_base=True, no_merge=True, fast=fast, mate_fix=mate_fix).collect()
    assert {(r.REF, r.POS): r.DEPTH for r in got} == depth(rows, LENGTHS, 512, fast, mate_fix)
    assert all(r.END == r.POS + 1 for r in got)


# strategy; base, quality, mapq of the mates; whether the first wins; the base recommended
MATES = [
    ("BASE_QUAL_MAP_QUAL_FIRST_IN_PAIR", "A", 2, 30, "C", 29, 30, False, None), ("BASE_QUAL_MAP_QUAL_FIRST_IN_PAIR", "A", 29, 40, "C", 29, 30, True, None),
    ("BASE_QUAL_MAP_QUAL_FIRST_IN_PAIR", "A", 29, 30, "C", 29, 30, True, None), ("BASE_QUAL_MAP_QUAL_IUPAC", "A", 2, 30, "C", 29, 30, False, None),
    ("BASE_QUAL_MAP_QUAL_IUPAC", "A", 29, 30, "G", 29, 30, True, "R"), ("BASE_QUAL_MAP_QUAL_N", "A", 2, 30, "C", 29, 30, False, None), ("BASE_QUAL_MAP_QUAL_N", "A", 29, 30, "C", 29, 30, True, "N"),
    ("MAP_QUAL_BASE_QUAL_FIRST_IN_PAIR", "A", 29, 40, "C", 29, 30, True, None), ("MAP_QUAL_BASE_QUAL_FIRST_IN_PAIR", "A", 2, 30, "C", 29, 30, False, None),
    ("MAP_QUAL_BASE_QUAL_FIRST_IN_PAIR", "A", 29, 30, "C", 29, 30, True, None), ("MAP_QUAL_BASE_QUAL_IUPAC", "A", 29, 40, "C", 29, 30, True, None), ("MAP_QUAL_BASE_QUAL_IUPAC", "A", 29, 30, "G", 29, 30, True, "R"),
    ("MAP_QUAL_BASE_QUAL_N", "A", 29, 40, "C", 29, 30, True, None), ("MAP_QUAL_BASE_QUAL_N", "A", 29, 30, "C", 29, 30, True, "N"), ("IUPAC", "A", 29, 30, "G", 29, 40, True, "R"),
    ("IUPAC", "A", 29, 30, "A", 29, 40, True, "A"), ("N", "A", 29, 30, "C", 29, 40, True, "N"), ("N", "A", 29, 30, "A", 29, 40, True, "A"), ("ORIGINAL", "A", 29, 40, "C", 29, 30, True, None),
    ("ORIGINAL", "A", 29, 30, "C", 29, 30, True, None),
]


def test_strategies(spark):
    """Every case is a contig of its own; the strategies run once each."""
    for strategy in Strategy:
        cases = [m for m in MATES if m[0] == strategy.name]
        contigs = {f"c{i}": 100 for i in range(len(cases))}
        rows = []
        for i, (_, b1, q1, m1, b2, q2, m2, _, _) in enumerate(cases):
            rows += [("PAIR", 67, f"c{i}", 11, m1, "10M", 16, 15, f"{b1}10", q1), ("PAIR", 147, f"c{i}", 16, m2, "10M", 11, 15, f"{b2}10", q2)]
        got = {(r.REF, r.POS): r for r in base_depth(*frames(spark, contigs, rows), mate_fix=True, strategy=strategy).collect()}
        for i, (_, b1, _, _, b2, _, _, first, rec) in enumerate(cases):
            for pos in range(16, 21):
                r = got[f"c{i}", pos]
                assert r[rec or (b1 if first else b2)] == 1 and r.DEPTH == 1 and r.COUNT_OF_MATE_RESOLUTIONS == 1, (strategy, i)


def test_original_prefers_the_first_mate(spark):
    rows = [("PAIR", 147, "c", 11, 30, "10M", 16, 15, "A10", 29), ("PAIR", 67, "c", 16, 30, "10M", 11, 15, "C10", 29)]
    got = base_depth(*frames(spark, {"c": 100}, rows), mate_fix=True).filter("POS = 17").first()
    assert (got.A, got.C) == (0, 1)


@pytest.mark.parametrize("mate_fix", [False, True])
def test_reads_without_sequence(spark, mate_fix):
    rows = [("a", 0, "chr1", 1, 40, "25M", 1, 0, "A25"), ("b", 0, "chr1", 10, 40, "25M", 1, 0, "*"), ("c", 0, "chr1", 15, 40, "25M", 1, 0, "G25")]
    got = base_depth(*frames(spark, {"chr1": 100}, rows), mate_fix=mate_fix).filter("POS = 15").first()
    assert (got.DEPTH, got.A, got.G, got.N) == (3, 1, 1, 1)
    rows = [("a", 0, "chr1", 1, 40, "25M", 1, 0, "A25", 40), ("b", 0, "chr1", 1, 40, "25M", 1, 0, "*")]
    got = base_depth(*frames(spark, {"chr1": 100}, rows), min_base_quality=20, mate_fix=mate_fix).filter("POS = 1").first()
    assert (got.DEPTH, got.A, got.N) == (2, 1, 1)


@pytest.mark.parametrize(
    "rows, merged",
    [
        ([("chr1", 0, 5, 2), ("chr1", 5, 9, 2)], [("chr1", 0, 9, 2)]),
        ([("chr1", 0, 5, 2), ("chr1", 6, 9, 2)], [("chr1", 0, 5, 2), ("chr1", 6, 9, 2)]),
        ([("chr1", 0, 5, 2), ("chr1", 5, 9, 3)], [("chr1", 0, 5, 2), ("chr1", 5, 9, 3)]),
        ([("chr1", 0, 9, 2), ("chr2", 5, 12, 2)], [("chr1", 0, 9, 2), ("chr2", 5, 12, 2)]),
        ([("chr1", 0, 20, 2), ("chr1", 5, 9, 2)], [("chr1", 0, 9, 2)]),
        ([("chr1", 3, None, 1), ("chr1", 4, None, 1)], [("chr1", 3, 5, 1)]),
        ([("chr1", 1048570, 1048580, 1), ("chr1", 1048580, 9000000, 1), ("chr1", 9000000, 9000001, 1)], [("chr1", 1048570, 9000001, 1)]),
        ([], []),
    ],
)
def test_merge_adjacent(spark, rows, merged):
    df = spark.createDataFrame(rows, "chrom string, chromStart bigint, chromEnd bigint, COV bigint")
    assert sorted(map(tuple, merge_adjacent(df).collect())) == merged
