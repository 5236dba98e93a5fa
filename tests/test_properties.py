"""Random intervals and reads against brute force."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from covergrid.operators import regions as R
from covergrid.operators.only_depth import only_depth
from tests.model import depth, frames

SOME = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
spans = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 4999), st.integers(1, 4999)), min_size=1, max_size=60)


@given(spans, spans, st.integers(50, 5000))
@SOME
def test_every_position_of_merged_regions_is_covered_once(spark, bed, sites, chunk):
    contigs = spark.createDataFrame([(i, c, 10_000) for i, c in enumerate("abc")], "tid int, ref string, length bigint")
    make = lambda rows: R.resolve(spark.createDataFrame(rows, "ref string, start bigint, stop bigint"), contigs)
    places = R.united(make([(c, a, a + n) for c, a, n in bed]), make([(c, a, a + 1) for c, a, _ in sites]))
    rows = only_depth(spark.createDataFrame([], "qname string, flag int, tid int, ref string, pos bigint, mapq int, cigar array<struct<len:int,op:string>>, mate_tid int, mate_pos bigint, tlen bigint, seq string, qual array<int>, ord bigint"),
                      contigs, places, chunksize=chunk, zero_base=True).collect()
    got = [(r.REF, p) for r in rows for p in range(r.POS, r.END)]
    want = {(c, p) for c, a, n in bed for p in range(a, a + n)} | {(c, a) for c, a, _ in sites}
    assert len(got) == len(set(got)) and set(got) == want


reads = st.lists(
    st.tuples(st.sampled_from("pqr"), st.sampled_from([67, 147, 0, 512]), st.sampled_from(["x", "y"]), st.integers(1, 200), st.sampled_from(["10M", "3M2I4M3D2M", "2M50N6M", "4S6M", "5D5M"]), st.integers(1, 200), st.integers(-60, 60)),
    min_size=1, max_size=25,
)


@given(reads, st.booleans(), st.booleans())
@SOME
def test_depth_of_random_reads(spark, some, fast, mate_fix):
    lengths = {"x": 230, "y": 300}
    rows = [(q, f, c, p, 40, cigar, m, t, "A20") for q, f, c, p, cigar, m, t in some]
    got = only_depth(*frames(spark, lengths, rows), fast=fast, mate_fix=mate_fix, no_merge=True, zero_base=True).collect()
    assert {(r.REF, r.POS): r.DEPTH for r in got} == depth(rows, lengths, 0, fast, mate_fix)
