"""Command line: base-depth, only-depth and merge-adjacent over files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="covergrid")
    sub = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("-o", "--output", default="-", help="a folder, or with --bgzip one file; - or none: standard output")
    shared.add_argument("-Z", "--bgzip", action="store_true")
    shared.add_argument("-L", "--compression-level", type=int, default=2)
    # Sizes of thread pools, caches and queues: command lines may have them, Spark sees to them itself.
    shared.add_argument("-T", "--compression-threads", type=int, help="ignored")
    depth = argparse.ArgumentParser(add_help=False, parents=[shared])
    depth.add_argument("reads")
    depth.add_argument("-r", "--ref-fasta")
    depth.add_argument("-b", "--bed-file")
    depth.add_argument("-B", "--bcf-file")
    depth.add_argument("-f", "--include-flags", type=int, default=0)
    depth.add_argument("-F", "--exclude-flags", type=int, default=0)
    depth.add_argument("-q", "--min-mapq", type=int, default=0)
    depth.add_argument("-m", "--mate-fix", action="store_true")
    depth.add_argument("-k", "--keep-zeros", action="store_true")
    depth.add_argument("-M", "--skip-merging-intervals", action="store_true")
    depth.add_argument("-z", "--zero-base", action="store_true")
    depth.add_argument("-t", "--threads", type=int, help="ignored")
    depth.add_argument("-C", "--channel-size-modifier", type=float, help="ignored")
    depth.add_argument("-c", "--chunksize", type=int, help="base-depth: ignored; only-depth: runs end at multiples of it")
    base = sub.add_parser("base-depth", parents=[depth])
    base.add_argument("--mate-resolution-strategy", default="original")
    base.add_argument("-Q", "--min-base-quality-score", type=int)
    base.add_argument("-D", "--max-depth", type=int, default=100_000)
    base.add_argument("--cap-depth", action="store_true", help="count no more than --max-depth reads at a position")
    base.add_argument("--ref-cache-size", type=int, help="ignored")
    only = sub.add_parser("only-depth", parents=[depth])
    only.add_argument("-x", "--fast-mode", action="store_true")
    only.add_argument("-n", "--no-merge", action="store_true")
    only.add_argument("--bed-format", action="store_true")
    merge = sub.add_parser("merge-adjacent", parents=[shared])
    merge.add_argument("in_file", nargs="?", default="-", help="- or none: standard input")
    merge.add_argument("-n", "--no-header", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    from covergrid.api import Engine
    from covergrid.functions.filters import ReadFilter
    from covergrid.operators.merge_adjacent import merge_adjacent
    from covergrid.sources import sinks, text

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("covergrid").getOrCreate()
    header = True
    if a.command == "merge-adjacent":
        source = sinks.spooled(spark, sys.stdin.buffer) if a.in_file == "-" else a.in_file
        out = merge_adjacent(text.intervals(spark, source, not a.no_header)).orderBy("REF", "POS")
    else:
        engine = Engine.open(spark, a.reads)
        regions = engine.regions(a.bed_file, a.bcf_file, merge=not a.skip_merging_intervals)
        common = {"keep": ReadFilter(a.include_flags, a.exclude_flags, a.min_mapq), "mate_fix": a.mate_fix, "keep_zeros": a.keep_zeros, "zero_base": a.zero_base, "merge_regions": False}
        if a.command == "base-depth":
            fasta = text.fasta_pieces(spark, a.ref_fasta) if a.ref_fasta else None
            out = engine.base_depth(regions, strategy=a.mate_resolution_strategy, min_base_quality=a.min_base_quality_score, max_depth=a.max_depth, cap_depth=a.cap_depth, fasta=fasta, **common)
        else:
            out = engine.only_depth(regions, fast=a.fast_mode, no_merge=a.no_merge, bed_format=a.bed_format, chunksize=a.chunksize, **common)
            header = not a.bed_format
        out = sinks.ordered(out, engine.contigs)
    if a.output == "-":
        sinks.stream(out, sys.stdout.buffer, header, a.bgzip, a.compression_level)
    elif a.bgzip:
        sinks.write_bgzf(out, a.output, header, a.compression_level)
    else:
        sinks.write_tsv(out, a.output, header)


if __name__ == "__main__":
    main()
