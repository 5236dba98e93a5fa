"""Work that regions and reads share is done once."""

import re

from covergrid.operators import regions as R
from covergrid.operators.only_depth import only_depth
from tests.test_pileup import frames, written


def some(spark, n=300):
    return frames(spark, [(f"o{i}", 0, 0, "x", i % 50, 40, [(100, "M")], 0, 0, 0, "A" * 100, [], i) for i in range(n)])


def test_duplicate_regions_share_the_sweep(spark):
    reads, contigs = some(spark)
    places = R.resolve(spark.createDataFrame([("x", 10, 200)] * 60 + [("x", 20, 30)], "ref string, start bigint, stop bigint"), contigs)
    n, records = written(spark, only_depth(reads, contigs, places, merge_regions=False, zero_base=True))
    assert n == 60 * 90 + 10 and records < 3_000


def test_chunks_of_duplicate_regions(spark):
    reads, contigs = some(spark, 2)
    places = R.resolve(spark.createDataFrame([("x", 10, 25), ("x", 10, 25)], "ref string, start bigint, stop bigint"), contigs)
    got = only_depth(reads, contigs, places, merge_regions=False, zero_base=True, chunksize=10).collect()
    assert sorted((r.POS, r.END, r.DEPTH) for r in got) == [(10, 20, 2)] * 2 + [(20, 25, 2)] * 2


def test_events_are_made_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = only_depth(*some(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"\bUnion\b", plan)) == 1


def test_interval_join_of_mixed_lengths(spark):
    """Short and long intervals on either side against brute force; short ones don't all meet in one bin."""
    spans = [(i, a, a + n) for i, (a, n) in enumerate([(0, 1), (5, 300_000), (250, 10), (255, 2), (16_380, 10), (16_384, 1), (40_000, 9_000), (99_999, 5), (300_000, 60_000)] + [(i * 37, 25) for i in range(400)])]
    regions = [(0, 16_384), (10, 20), (255, 257), (256, 512), (16_383, 16_385), (39_000, 200_000), (0, 400_000), (299_999, 300_001)] + [(i * 130, i * 130 + 100) for i in range(200)]
    contigs = spark.createDataFrame([(0, "x", 500_000)], "tid int, ref string, length bigint")
    s = spark.createDataFrame([(0, *x) for x in spans], "tid int, i int, start bigint, stop bigint")
    for chosen in (regions, regions[1:5] + regions[8:]):
        places = R.resolve(spark.createDataFrame([("x", *r) for r in chosen], "ref string, start bigint, stop bigint"), contigs)
        joined = R.clip(s, places, ["i"])
        got = sorted((r.i, r.start, r.stop, r.a, r.z) for r in joined.collect())
        assert got == sorted((i, p, q, max(a, p), min(z, q)) for i, a, z in spans for p, q in chosen if a < q and p < z)
