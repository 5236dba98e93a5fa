"""Files in and out."""

import gzip
import struct

import pytest

from covergrid.__main__ import main
from covergrid.api import Engine
from covergrid.operators import regions as R
from covergrid.sources import bam, bcf, sinks, text

SAM = "\n".join([
    "@HD\tVN:1.6", "@SQ\tSN:zz\tLN:50", "@SQ\tSN:aa\tLN:40",
    "r1\t67\tzz\t1\t40\t4M1I3M\t=\t5\t12\tACGTTACG\tIIII!III", "r1\t147\tzz\t5\t40\t8M\t=\t1\t-12\tTACGTACG\t*",
    "r2\t0\taa\t38\t7\t5M\t*\t0\t0\t*\t*", "r3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII",
]) + "\n"


@pytest.fixture(scope="module")
def sam(tmp_path_factory):
    p = tmp_path_factory.mktemp("sam") / "x.sam"
    p.write_text(SAM)
    return str(p)


def bam_bytes(rows, contigs=(("zz", 50), ("aa", 40))):
    """rows: (tid, pos, qname, cigar, seq, flag), and tags where a seventh field is"""
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(contigs))
    for name, n in contigs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    starts = []
    for tid, pos, qname, cigar, seq, flag, *tags in rows:
        codes = [bam.SEQ_CODES.index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(qname) + 1, 40, 0, len(cigar), flag, len(seq), -1, -1, 0) + qname.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | bam.CIGAR_CODES.index(op)) for n, op in cigar)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + bytes([30] * len(seq)) + b"".join(tags)
        starts.append(len(out))
        out += struct.pack("<i", len(body)) + body
    return out, starts


def blocked(raw, size):
    """Block-gzipped bytes, and a function from places in raw to virtual offsets."""
    blocks, at, where = [], 0, {}
    for i in range(0, len(raw), size):
        where[i] = at
        blocks.append(sinks.block(raw[i : i + size]))
        at += len(blocks[-1])
    where[len(raw) // size * size] = where.get(len(raw) // size * size, at)
    return b"".join(blocks) + sinks.EOF, lambda i: where[i // size * size] << 16 | i % size


def leaf(pos):
    return 4681 + (pos >> 14)


def indexed(rows, starts, end, virtual, csi):
    """An index in which every record is a chunk of its leaf bin."""
    out = b"CSI\1" + struct.pack("<3i", 14, 5, 0) if csi else b"BAI\1"
    out += struct.pack("<i", 2)
    ends = [*starts[1:], end]
    for tid in range(2):
        bins, linear = {}, {}
        for r, a, z in zip(rows, starts, ends):
            if r[0] == tid:
                bins.setdefault(leaf(r[1]), []).append((virtual(a), virtual(z)))
                linear.setdefault(r[1] >> 14, virtual(a))
        out += struct.pack("<i", len(bins) + 1)
        for number, chunks in bins.items():
            out += struct.pack("<I", number) + (struct.pack("<Q", chunks[0][0]) if csi else b"")
            out += struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<I", 37450) + (struct.pack("<Q", 0) if csi else b"") + struct.pack("<i", 2) + bytes(32)  # counts
        if not csi:
            n = max(linear, default=-1) + 1
            out += struct.pack("<i", n) + b"".join(struct.pack("<Q", linear.get(i, 0)) for i in range(n))
    return gzip.compress(out) if csi else out


def test_sam(spark, sam):
    e = Engine.open(spark, sam)
    assert [tuple(r) for r in e.contigs.orderBy("tid").collect()] == [(0, "zz", 50), (1, "aa", 40)]
    rows = {(r.qname, r.flag): r for r in e.reads.collect()}
    r = rows["r1", 67]
    assert (r.pos, r.tid, r.mate_tid, r.mate_pos, r.tlen, r.seq) == (0, 0, 0, 4, 12, "ACGTTACG") and r.qual[4] == 0 and r.qual[0] == 40
    assert [tuple(x) for x in r.cigar] == [(4, "M"), (1, "I"), (3, "M")]
    assert rows["r1", 147].qual == [255] * 8 and rows["r2", 0].seq is None and rows["r2", 0].qual == []
    got = {(r.REF, r.POS): r for r in e.base_depth().collect()}
    assert got["zz", 4].INS == 1 and got["zz", 5].DEPTH == 2 and got["aa", 40].N == 1 and ("aa", 41) not in got


@pytest.mark.parametrize("size", [60, 10_000])
def test_bam_in_ranges(spark, tmp_path, size):
    rows = [(i % 2, i, f"q{i}", [(5, "M")], "ACGTN" if i % 3 else "", 0) for i in range(40)]
    raw, starts = bam_bytes(rows)
    data, virtual = blocked(raw, size)
    path = tmp_path / "x.bam"
    path.write_bytes(data)
    points = [virtual(s) for s in starts[::7]]
    (tmp_path / "x.bam.bai").write_bytes(b"BAI\1" + struct.pack("<iii", 1, 0, len(points)) + struct.pack(f"<{len(points)}Q", *points))
    reads = bam.reads(spark, str(path), split=1).orderBy("ord").collect()
    assert [(r.tid, r.pos, r.qname, r.seq, r.qual) for r in reads] == [(t, p, q, s or None, [30] * len(s)) for t, p, q, _, s, _ in rows]
    assert [r.ord for r in reads] == [virtual(s) for s in starts] and {r.ref for r in reads} == {"zz", "aa"}
    assert [r.ref for r in bam.contigs(spark, str(path)).orderBy("tid").collect()] == ["zz", "aa"]
    path.write_bytes(data[: len(data) - len(sinks.EOF) - 30])
    with pytest.raises(Exception):
        bam.reads(spark, str(path)).collect()


@pytest.mark.parametrize("csi", [False, True])
def test_regions_are_fetched_by_the_index(spark, tmp_path, csi):
    rows = sorted((i % 2, i * 997 % 200_000, f"q{i}", [(50, "M")], "A" * 50, 0) for i in range(3000))
    raw, starts = bam_bytes(rows, (("zz", 200_000), ("aa", 200_000)))
    data, virtual = blocked(raw, 4000)
    path = tmp_path / "x.bam"
    path.write_bytes(data)
    (tmp_path / ("x.bam.csi" if csi else "x.bam.bai")).write_bytes(indexed(rows, starts, len(raw), virtual, csi))
    (tmp_path / "r.bed").write_text("zz\t40000\t40100\naa\t90000\t91000\naa\t90500\t91500\n")
    e = Engine.open(spark, str(path))
    regions = e.regions(str(tmp_path / "r.bed"))
    near = e.near(regions).collect()
    assert 0 < len(near) < len(rows) / 4 and len({r.ord for r in near}) == len(near)
    size = lambda todo: sum((z >> 16) - (a >> 16) + 1 for a, z in todo)
    places = [(0, 40_000, 40_100), (1, 90_000, 91_500)]
    assert size(bam.ranges(str(path), 1 << 20, places)) < len(data) / 4 and size(bam.ranges(str(path), 1 << 20, places[:1])) < size(bam.ranges(str(path), 1 << 20, places))
    whole = Engine(spark, e.reads, e.contigs)
    for name in ("base_depth", "only_depth"):
        assert sorted(map(tuple, getattr(e, name)(regions).collect())) == sorted(map(tuple, getattr(whole, name)(regions).collect()))
    assert e.near(regions.limit(0)).count() == 0


def test_operations_that_are_kept_in_a_tag(spark, tmp_path):
    long = [(1, "M"), (1, "I")] * 40_000
    tag = b"CGBI" + struct.pack("<i", len(long)) + b"".join(struct.pack("<I", n << 4 | bam.CIGAR_CODES.index(op)) for n, op in long)
    other = b"NMC\1" + b"MDZ12A\0" + b"XBBs" + struct.pack("<i2h", 2, 1, 2)
    rows = [(0, 0, "a", [(4, "M")], "ACGT", 0, other), (0, 3, "b", [(80_000, "S"), (40_000, "N")], "AC" * 40_000, 0, other, tag), (0, 5, "c", [(2, "S"), (3, "N")], "AC", 0)]
    raw, _ = bam_bytes(rows, (("zz", 50_000),))
    (tmp_path / "x.bam").write_bytes(blocked(raw, 60_000)[0])
    reads = {r.qname: r for r in bam.reads(spark, str(tmp_path / "x.bam")).collect()}
    assert [tuple(x) for x in reads["b"].cigar] == long and [tuple(x) for x in reads["c"].cigar] == [(2, "S"), (3, "N")] and len(reads["a"].cigar) == 1
    got = Engine.open(spark, str(tmp_path / "x.bam")).base_depth().filter("REF = 'zz' AND POS = 30000").first()
    assert (got.A, got.INS) == (1, 1)


def test_contigs_longer_than_a_partition(spark, tmp_path):
    """Lines of uneven length, contigs across the reader's partitions, empty contigs and lines."""
    import random

    rnd = random.Random(1)
    seqs = {name: "".join(rnd.choice("ACGTacgtN") for _ in range(n)) for name, n in (("a", 5000), ("b", 0), ("c", 1), ("d", 2600), ("e", 64))}
    with open(tmp_path / "x.fa", "w") as f:
        for name, seq in seqs.items():
            f.write(f">{name} text\n")
            while seq:
                n = rnd.randint(1, 90)
                f.write(seq[:n] + rnd.choice(["\n", "\n", "\n\n", " \n"]))
                seq = seq[n:]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = text.fasta_pieces(spark, str(tmp_path / "x.fa"), 6).collect()
            assert {(r.ref, r.piece): r.bases for r in got} == {(k, i): s[64 * i : 64 * i + 64] for k, s in seqs.items() for i in range(-(-len(s) // 64))}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_capped_depth(spark):
    from covergrid.operators.base_depth import base_depth
    from tests.model import frames

    rows = [(f"q{i}", 0, "c", 1 + i, 40, "5M", 1, 0, f"{'ACGT'[i % 4]}5") for i in range(6)]
    got = {r.POS: r for r in base_depth(*frames(spark, {"c": 50}, rows), max_depth=2, cap_depth=True).collect()}
    assert [got[p].DEPTH for p in range(1, 11)] == [1, 2, 2, 2, 2, 2, 2, 2, 2, 1] and got[5].A == got[5].C == 1 and got[5].G == 0
    pair = [("q", 67, "c", 1, 40, "5M", 1, 5, "A5"), ("q", 147, "c", 1, 40, "5M", 1, -5, "C5"), ("r", 0, "c", 1, 40, "5M", 1, 0, "G5")]
    got = base_depth(*frames(spark, {"c": 50}, pair), max_depth=2, cap_depth=True, mate_fix=True).first()
    assert (got.DEPTH, got.A, got.G, got.COUNT_OF_MATE_RESOLUTIONS) == (1, 1, 0, 1)


def test_standard_input_and_output(spark, sam, monkeypatch, capfdbinary):
    import io
    import sys

    table = b"REF\tPOS\tEND\tDEPTH\na\t1\t5\t2\na\t5\t9\t2\n"
    for data in (table, gzip.compress(table)):
        monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(data)))
        main(["merge-adjacent", "-T", "2"])
        assert capfdbinary.readouterr().out.endswith(b"REF\tPOS\tEND\tDEPTH\na\t1\t9\t2\n")
    main(["only-depth", sam, "-t", "4", "-C", "0.1", "-T", "2", "-Z"])
    out = capfdbinary.readouterr().out
    assert out.endswith(sinks.EOF) and gzip.decompress(out[out.index(b"\x1f\x8b") :]).startswith(b"REF\tPOS\tEND\tDEPTH\nzz\t1\t5\t1\n")
    main(["base-depth", sam, "-c", "10", "--ref-cache-size", "3", "--cap-depth", "-D", "5"])
    assert b"\nzz\t5\t" in capfdbinary.readouterr().out


def test_regions_from_files(spark, sam, tmp_path):
    e = Engine.open(spark, sam)
    (tmp_path / "r.bed").write_text("track x\nzz\t3\t10\nzz\t8\t12\naa\t35\t90\naa\t2\t2\n")
    (tmp_path / "s.vcf").write_text("##x\n#CHROM\tPOS\nzz\t13\t.\nzz\t30\t.\n")
    header = b'##contig=<ID=zz,length=50>\n##contig=<ID=aa,length=40>\n\0'
    raw = b"BCF\2\2" + struct.pack("<I", len(header)) + header + b"".join(struct.pack("<II", 24, 0) + struct.pack("<ii", 0, p) + bytes(16) for p in (12, 29))
    (tmp_path / "s.bcf").write_bytes(sinks.block(raw) + sinks.EOF)
    bed, vcf = str(tmp_path / "r.bed"), str(tmp_path / "s.vcf")
    spans = lambda df: sorted((r.ref, r.start, r.stop) for r in df.collect())
    assert spans(e.regions(bed)) == [("aa", 35, 40), ("zz", 3, 12)]
    assert spans(e.regions(bed, vcf)) == [("aa", 35, 40), ("zz", 3, 13), ("zz", 29, 30)]
    assert spans(bcf.sites(spark, str(tmp_path / "s.bcf"))) == [("zz", 12, 13), ("zz", 29, 30)]
    assert len(spans(e.regions(bed, merge=False))) == 3
    for bad in ("nowhere\t1\t2\n", "zz\t5\t2\n"):
        (tmp_path / "bad.bed").write_text(bad)
        with pytest.raises(Exception, match="unknown contig|ends before"):
            e.regions(str(tmp_path / "bad.bed")).collect()


def test_fasta_and_command_line(spark, sam, tmp_path):
    (tmp_path / "f.fa").write_text(">zz some text\nACGTacgtNN\n" + "C" * 40 + "\n>aa\n" + "GT" * 20 + "\n")
    assert {r.ref: len(r.seq) for r in text.fasta(spark, str(tmp_path / "f.fa")).collect()} == {"zz": 50, "aa": 40}
    out = str(tmp_path / "out.tsv.gz")
    main(["base-depth", sam, "-r", str(tmp_path / "f.fa"), "-o", out, "-Z", "-k"])
    lines = gzip.open(out, "rt").read().splitlines()
    assert lines[0].split("\t")[:4] == ["REF", "POS", "REF_BASE", "DEPTH"] and len(lines) == 91
    assert [x.split("\t")[0] for x in lines[1:]] == ["zz"] * 50 + ["aa"] * 40 and lines[5].split("\t")[2] == "a"
    assert open(out, "rb").read().endswith(sinks.EOF)
    runs = str(tmp_path / "runs.tsv.gz")
    main(["only-depth", sam, "-o", runs, "-Z", "-z", "-n"])
    merged = str(tmp_path / "merged.tsv.gz")
    main(["merge-adjacent", runs, "-o", merged, "-Z"])
    assert gzip.open(merged, "rt").read().splitlines()[:3] == ["REF\tPOS\tEND\tDEPTH", "aa\t37\t40\t1", "zz\t0\t4\t1"]
    main(["only-depth", sam, "-o", str(tmp_path / "bed"), "--bed-format", "-x", "-m"])
    assert any(p.suffix == ".csv" for p in (tmp_path / "bed").iterdir())


def test_user_processor(spark, sam):
    import pandas as pd

    e = Engine.open(spark, sam)

    def longest(region, reads):
        return pd.DataFrame({"ref": [region.get("ref")], "start": [region.get("start")], "n": [len(reads)]})

    rows = e.run(longest, "ref string, start long, n long", chunksize=25).collect()
    assert sorted(map(tuple, rows)) == [("aa", 0, 0), ("aa", 25, 1), ("zz", 0, 2), ("zz", 25, 0)]


def test_chunks_keep_regions_apart(spark):
    contigs = spark.createDataFrame([(0, "a", 100)], "tid int, ref string, length bigint")
    twice = R.resolve(spark.createDataFrame([("a", 5, 50), ("a", 5, 50)], "ref string, start bigint, stop bigint"), contigs)
    assert R.chunked(twice, 20).count() == 6 and R.chunked(twice, 20).select("rid").distinct().count() == 6
