"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covergrid.api import Engine
from covergrid.functions import cigar
from covergrid.functions.bases import base, either_or
from covergrid.functions.filters import ReadFilter, may_overlap_mate
from covergrid.operators import merge_adjacent as M
from covergrid.operators import regions as R
from covergrid.operators.base_depth import base_depth
from covergrid.operators.mates import Strategy
from covergrid.operators.only_depth import only_depth
from covergrid.plans import driver_tables as T
from covergrid.schema import COUNTS

Query = Callable[[SparkSession, str], DataFrame]
KEEP = ReadFilter(include=1, exclude=512, min_mapq=5)
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


# ---- SQL parts ----------------------------------------------------------------------------------

PASS = "((~flag) & 1) = 0 AND (flag & 512) = 0 AND mapq >= 5"
OVERLAPS = "((flag & 1) <> 0 AND tid = mate_tid AND (abs(tlen) // 2 < span OR abs(mate_pos - pos) < span))"
_CTE = f"""reads AS ({T.READS_SQL}),
contigs(tid, ref, length) AS (VALUES {', '.join(f"({i}, '{r}', {T.LENGTH})" for i, r in enumerate(T.CONTIG_NAMES))}),
ops(cigar_text, op, r, q, n, ins) AS (VALUES ('25M','M',0,0,25,false), ('2M2I21M','M',0,0,2,true), ('2M2I21M','M',2,4,21,false), ('2M5D23M','M',0,0,2,false),
  ('2M5D23M','D',2,2,5,false), ('2M5D23M','M',7,2,23,false), ('3M5N22M','M',0,0,3,false), ('3M5N22M','N',3,3,5,false), ('3M5N22M','M',8,3,22,false)),
spans AS (SELECT cigar_text, CAST(max(r + n) AS BIGINT) AS span FROM ops GROUP BY cigar_text),
passed AS (SELECT *, {OVERLAPS} AS meets FROM reads JOIN spans USING (cigar_text) WHERE {PASS}),
beds AS (SELECT row_number() OVER () AS rid, ref, start, least(stop, length) AS stop FROM ({T.INTERVALS_SQL}) JOIN contigs USING (ref) WHERE least(stop, length) > start),
vcfs AS (SELECT row_number() OVER () AS rid, ref, start, stop FROM ({T.SITES_SQL}) JOIN contigs USING (ref)),
grid AS (SELECT ref, unnest(range(0, length)) AS p FROM contigs)"""


def _islands(source: str) -> str:
    """Merged regions of a relation (ref, start, stop), by the positions that it covers."""
    return f"""(SELECT ref, min(p) AS start, max(p) + 1 AS stop FROM (SELECT ref, p, p - row_number() OVER (PARTITION BY ref ORDER BY p) AS island
      FROM (SELECT DISTINCT ref, unnest(range(start, stop)) AS p FROM {source})) GROUP BY ref, island)"""


def _covered(fast: bool, mate_fix: bool) -> str:
    """(ref, p): a row for each unit of depth."""
    blocks = "SELECT ref, qname, meets, unnest(range(pos, pos + span)) AS p FROM passed" if fast else "SELECT ref, qname, meets, unnest(range(pos + r, pos + r + n)) AS p FROM passed JOIN ops USING (cigar_text) WHERE op <> 'N'"
    if not mate_fix:
        return f"SELECT ref, p FROM ({blocks})"
    return f"SELECT ref, p FROM ({blocks}) WHERE NOT meets UNION ALL SELECT ref, p FROM (SELECT DISTINCT ref, qname, p FROM ({blocks}) WHERE meets)"


def _depth_sql(fast=False, mate_fix=False, runs=True, zeros=True, shift=1, regions="(SELECT row_number() OVER () AS rid, ref, 0 AS start, length AS stop FROM contigs)", columns=("REF", "POS", "END", "DEPTH")) -> str:
    per = f"""levels AS (SELECT rid, g.ref, g.p, coalesce(d, 0) AS d FROM (SELECT rid, ref, unnest(range(start, stop)) AS p FROM {regions}) g
      LEFT JOIN (SELECT ref, p, count(*) AS d FROM ({_covered(fast, mate_fix)}) GROUP BY ref, p) c ON g.ref = c.ref AND g.p = c.p)"""
    if runs:
        body = "SELECT ref, min(p) AS a, max(p) + 1 AS z, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p) - row_number() OVER (PARTITION BY rid, d ORDER BY p) AS run FROM levels) GROUP BY rid, ref, d, run"
    else:
        body = "SELECT ref, p AS a, p + 1 AS z, d FROM levels"
    names = f"ref AS {columns[0]}, CAST(a + {shift} AS BIGINT) AS {columns[1]}, CAST(z + {shift} AS BIGINT) AS {_quoted(columns[2])}, "
    names += "'' AS name, CAST(d AS BIGINT) AS score" if len(columns) == 5 else "CAST(d AS BIGINT) AS DEPTH"
    return f"WITH {_CTE}, {per} SELECT {names} FROM ({body})" + ("" if zeros else " WHERE d <> 0")


def _quoted(name: str) -> str:
    return '"END"' if name == "END" else name


# ---- parts of the engine ------------------------------------------------------------------------


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, T.reads(spark, sf_dir), T.contigs(spark))


def _beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve(T.intervals(spark, sf_dir), T.contigs(spark))


def _vcfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve(T.sites(spark, sf_dir), T.contigs(spark))


@query("read_filter", f"WITH {_CTE} SELECT ord, ({PASS}) AS pass FROM reads")
def _(spark, sf):
    return T.reads(spark, sf).select("ord", KEEP().alias("pass"))


@query("aligned_blocks", f"WITH {_CTE} SELECT ord, CAST(pos + r AS BIGINT) AS start, CAST(pos + r + n AS BIGINT) AS stop FROM reads JOIN ops USING (cigar_text) WHERE op <> 'N'")
def _(spark, sf):
    return cigar.with_blocks(T.reads(spark, sf), "ord")


@query("read_span", f"WITH {_CTE} SELECT ord, CAST(pos AS BIGINT) AS start, CAST(pos + span AS BIGINT) AS stop FROM reads JOIN spans USING (cigar_text)")
def _(spark, sf):
    return T.reads(spark, sf).select("ord", F.col("pos").alias("start"), (F.col("pos") + cigar.span(F.col("cigar"))).alias("stop"))


@query("mate_overlap_flag", f"WITH {_CTE} SELECT ord, {OVERLAPS} AS meets FROM reads JOIN spans USING (cigar_text)")
def _(spark, sf):
    return T.reads(spark, sf).select("ord", may_overlap_mate(cigar.span(F.col("cigar"))).alias("meets"))


@query("regions_chunked", f"WITH {_CTE} SELECT ref, a AS start, least(a + 3000, length) AS stop FROM (SELECT ref, length, unnest(range(0, length, 3000)) AS a FROM contigs)")
def _(spark, sf):
    return R.chunked(R.whole(T.contigs(spark)), 3000).select("ref", "start", "stop")


@query("regions_merged", f"WITH {_CTE} SELECT ref, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM {_islands('beds')}")
def _(spark, sf):
    return R.merged(_beds(spark, sf)).select("ref", "start", "stop")


@query("regions_union", f"WITH {_CTE} SELECT ref, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM {_islands('(SELECT ref, start, stop FROM beds UNION ALL SELECT ref, start, stop FROM vcfs)')}")
def _(spark, sf):
    return R.united(_beds(spark, sf), _vcfs(spark, sf)).select("ref", "start", "stop")


@query("regions_union_all", f"WITH {_CTE} SELECT ref, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM beds UNION ALL SELECT ref, CAST(start AS BIGINT), CAST(stop AS BIGINT) FROM vcfs")
def _(spark, sf):
    return R.united(_beds(spark, sf), _vcfs(spark, sf), merge=False).select("ref", "start", "stop")


@query(
    "region_overlap_join",
    f"""WITH {_CTE} SELECT ord, r.ref, CAST(g.start AS BIGINT) AS region_start, CAST(g.stop AS BIGINT) AS region_stop, CAST(greatest(pos, g.start) AS BIGINT) AS start, CAST(least(pos + span, g.stop) AS BIGINT) AS stop
    FROM (SELECT * FROM reads JOIN spans USING (cigar_text)) r JOIN beds g ON r.ref = g.ref AND pos < g.stop AND pos + span > g.start""",
)
def _(spark, sf):
    spans = T.reads(spark, sf).select("tid", "ord", F.col("pos").alias("start"), (F.col("pos") + cigar.span(F.col("cigar"))).alias("stop"))
    hits = R.clip(spans, _beds(spark, sf), ["ord"])
    return hits.select("ord", "ref", F.col("start").alias("region_start"), F.col("stop").alias("region_stop"), F.col("a").alias("start"), F.col("z").alias("stop"))


# ---- interval depth -----------------------------------------------------------------------------


def _only(name: str, sql: str, regions: Callable | None = None, **options) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return only_depth(T.reads(spark, sf), T.contigs(spark), regions(spark, sf) if regions else None, keep=KEEP, **options)

    query(name, sql)(run)


_only("only_depth_ranges", _depth_sql())
_only("only_depth_fast", _depth_sql(fast=True), fast=True)
_only("only_depth_mate_fix", _depth_sql(mate_fix=True), mate_fix=True)
_only("only_depth_fast_mate_fix", _depth_sql(fast=True, mate_fix=True), fast=True, mate_fix=True)
_only("only_depth_no_merge", _depth_sql(runs=False, zeros=False), no_merge=True)
_only("only_depth_no_merge_keep_zeros", _depth_sql(runs=False), no_merge=True, keep_zeros=True)
_only("only_depth_zero_base", _depth_sql(shift=0), zero_base=True)
_only("only_depth_drop_zero_runs", _depth_sql(zeros=False), drop_zero_runs=True)
_only("only_depth_bed_format", _depth_sql(columns=("chrom", "chromStart", "chromEnd", "name", "score"), shift=0), bed_format=True, zero_base=True)
_only("only_depth_chunked", _depth_sql(regions="(SELECT row_number() OVER () AS rid, ref, a AS start, least(a + 700, length) AS stop FROM (SELECT ref, length, unnest(range(0, length, 700)) AS a FROM contigs))"), chunksize=700)
_only("only_depth_regions", _depth_sql(regions=f"(SELECT row_number() OVER () AS rid, * FROM {_islands('beds')})"), _beds)
_only("only_depth_regions_duplicates", _depth_sql(regions="beds"), _beds, merge_regions=False)
_only("only_depth_sites", _depth_sql(regions=f"(SELECT row_number() OVER () AS rid, * FROM {_islands('vcfs')})"), _vcfs)


# ---- per-base depth -----------------------------------------------------------------------------


def _base_sql(strategy: Strategy | None = None, quality: int | None = None, zeros=False, shift=1, fasta=False, near=99_000, regions="(SELECT row_number() OVER () AS rid, ref, 0 AS start, length AS stop FROM contigs)") -> str:
    rows = f"""aligned AS (SELECT g.rid, x.* FROM (SELECT ref, pos + r + i AS p, qname, ({PASS}) AS pass, mapq, (flag & 64) // 64 AS first, ord, op, op = 'M' AND seq <> '' AS has_base, ins AND i = n - 1 AS ins,
        CASE WHEN op = 'M' AND seq <> '' THEN substr(seq, CAST(q + i + 1 AS INT), 1) END AS base, CASE WHEN op = 'M' AND seq <> '' THEN (strpos('0123456789abcdef', substr(qual_text, CAST(q + i + 1 AS INT), 1)) - 1) * 3 END AS bq
        FROM (SELECT *, unnest(range(0, n)) AS i FROM reads JOIN ops USING (cigar_text))) x JOIN {regions} g ON x.ref = g.ref AND p >= g.start AND p < g.stop)"""
    if strategy is None:
        picked = "picked AS (SELECT *, 1 AS n, NULL AS rec FROM aligned)"
    else:
        # The best read by rank, the runner-up by lead; names with a read that has no base here order by mapq, first.
        keys = {Strategy.ORIGINAL: "mapq, first", Strategy.IUPAC: "0, 0", Strategy.N: "0, 0"}.get(strategy) or ", ".join(strategy.keys) + (", first" if strategy.first else ", 0")
        parts = [*[k.strip() for k in keys.split(",")], "0"][:3]
        order = "CAST(pass AS INT) DESC, " + ", ".join(f"CASE WHEN pairs THEN {k} ELSE {o} END DESC" for k, o in zip(parts, ("mapq", "first", "0"))) + ", ord"
        if strategy.tie is None:
            rec = "NULL"
        else:
            ambiguity = "" if strategy.tie == "n" else " ".join(f"WHEN least(base, base2) || greatest(base, base2) = '{k}' THEN '{v}'" for k, v in {"AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M"}.items())
            same = "AND bq = bq2 AND mapq = mapq2" if strategy.keys else ""
            rec = f"CASE WHEN n >= 2 AND pass AND pass2 AND pairs {same} THEN CASE WHEN base = base2 THEN base {ambiguity} ELSE 'N' END END"
        picked = f"""picked AS (SELECT *, {rec} AS rec FROM (SELECT *, row_number() OVER w AS rank, lead(base) OVER w AS base2, lead(bq) OVER w AS bq2, lead(mapq) OVER w AS mapq2, lead(pass) OVER w AS pass2
          FROM (SELECT *, count(*) OVER g AS n, bool_and(has_base) OVER g AS pairs FROM aligned WINDOW g AS (PARTITION BY rid, p, qname))
          WINDOW w AS (PARTITION BY rid, p, qname ORDER BY {order})) WHERE rank = 1)"""
    masked = "false" if quality is None else f"(bq IS NULL OR bq < {quality})"
    called = f"called AS (SELECT *, CASE WHEN op <> 'M' THEN op WHEN {masked} THEN 'N' WHEN rec IS NOT NULL THEN rec WHEN NOT has_base THEN 'N' ELSE base END AS call FROM picked)"
    number = lambda c, a: f'CAST(count(*) FILTER ({c}) AS BIGINT) AS "{a}"'
    sums = [number("pass AND op <> 'N'", "DEPTH"), *(number(f"pass AND op = 'M' AND call = '{b}'", b) for b in "ACGTNRYSWKM"), number("pass AND ins", "INS"), number("pass AND op = 'D'", "DEL")]
    sums += [number("pass AND op = 'N'", "REF_SKIP"), number("NOT pass", "FAIL"), number("pass AND n >= 2", "COUNT_OF_MATE_RESOLUTIONS"), "CAST(sum(n) AS BIGINT) AS raw"]
    counted = f"counted AS (SELECT rid, ref, p, {', '.join(sums)} FROM called GROUP BY rid, ref, p)"
    source = "counted"
    if zeros:
        filled = ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in [*COUNTS, "raw"])
        source = f"(SELECT g.ref, g.p, {filled} FROM (SELECT rid, ref, unnest(range(start, stop)) AS p FROM {regions}) g LEFT JOIN counted c ON g.rid = c.rid AND g.p = c.p)"
    letter = "substr('ACGTacN', CAST((CAST(p AS BIGINT) * p + CAST(substr(ref, 4) AS INT) - 1) % 7 + 1 AS INT), 1) AS REF_BASE, " if fasta else ""
    columns = ", ".join(f'"{c}"' for c in COUNTS)
    return f"WITH {_CTE}, {rows}, {picked}, {called}, {counted} SELECT ref AS REF, CAST(p + {shift} AS BIGINT) AS POS, {letter}{columns}, raw > {near} AS NEAR_MAX_DEPTH FROM {source}"


def _pile(name: str, sql: str, regions: Callable | None = None, fasta: bool = False, **options) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return base_depth(T.reads(spark, sf), T.contigs(spark), regions(spark, sf) if regions else None, keep=KEEP, fasta=T.fasta(spark) if fasta else None, **options)

    query(name, sql)(run)


_MERGED_BEDS = f"(SELECT row_number() OVER () AS rid, * FROM {_islands('beds')})"
_pile("base_depth", _base_sql())
_pile("base_depth_base_qual", _base_sql(quality=20), min_base_quality=20)
_pile("base_depth_keep_zeros", _base_sql(zeros=True), keep_zeros=True)
_pile("base_depth_regions", _base_sql(regions=_MERGED_BEDS), _beds)
_pile("base_depth_regions_duplicates", _base_sql(regions="beds"), _beds, merge_regions=False)
_pile("base_depth_regions_keep_zeros", _base_sql(regions="beds", zeros=True), _beds, merge_regions=False, keep_zeros=True)
_pile("base_depth_zero_base", _base_sql(shift=0), zero_base=True)
_pile("base_depth_ref_base", _base_sql(fasta=True), fasta=True)
_pile("base_depth_ref_base_keep_zeros", _base_sql(fasta=True, zeros=True), fasta=True, keep_zeros=True)
_pile("base_depth_near_max", _base_sql(near=5), max_depth=5)
for _s in Strategy:
    _pile(f"base_depth_mate_{_s.name.lower()}", _base_sql(_s), mate_fix=True, strategy=_s)
_pile("base_depth_mate_base_qual", _base_sql(Strategy.BASE_QUAL_MAP_QUAL_IUPAC, quality=20), mate_fix=True, strategy="base_qual_map_qual_iupac", min_base_quality=20)


# ---- merge-adjacent, bases, processors -----------------------------------------------------------

_ROWS = "SELECT concat('chr', l_orderkey % 3 + 1) AS REF, l_orderkey * 3 + l_linenumber AS POS, l_orderkey * 3 + l_linenumber * 3 AS \"END\", l_suppkey % 2 AS DEPTH FROM lineitem"
_MERGE = """WITH r AS (SELECT REF, POS, {end} AS e, DEPTH FROM ({rows})),
b AS (SELECT *, CASE WHEN lag(DEPTH) OVER w = DEPTH AND lag(e) OVER w >= POS THEN 0 ELSE 1 END AS fresh, row_number() OVER w AS nth FROM r WINDOW w AS (PARTITION BY REF ORDER BY POS, e, DEPTH)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY REF ORDER BY nth) AS island FROM b)
SELECT REF, CAST(min(POS) AS BIGINT) AS POS, CAST(arg_max(e, nth) AS BIGINT) AS "END", CAST(min(DEPTH) AS BIGINT) AS DEPTH FROM i GROUP BY REF, island"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_ROWS.replace('"END"', "`END`").replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))


@query("merge_adjacent", _MERGE.format(end='"END"', rows=_ROWS))
def _(spark, sf):
    return M.merge_adjacent(_rows(spark, sf))


@query("merge_adjacent_no_end", _MERGE.format(end="POS + 1", rows=_ROWS))
def _(spark, sf):
    return M.merge_adjacent(_rows(spark, sf).select(F.col("REF").alias("chrom"), F.col("POS").alias("chromStart"), F.col("DEPTH").alias("COV")))


@query(
    "iupac_either_or",
    """WITH l(a) AS (VALUES ('A'), ('c'), ('G'), ('u'), ('t'), ('N'), ('x')), n AS (SELECT a, CASE WHEN upper(a) = 'U' THEN 'T' WHEN upper(a) IN ('A', 'C', 'G', 'T') THEN upper(a) ELSE 'N' END AS b FROM l),
    p AS (SELECT x.a AS one, y.a AS two, least(x.b, y.b) || greatest(x.b, y.b) AS pair FROM n x, n y)
    SELECT one, two, CASE pair WHEN 'AA' THEN 'A' WHEN 'CC' THEN 'C' WHEN 'GG' THEN 'G' WHEN 'TT' THEN 'T' WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'GT' THEN 'K' WHEN 'AC' THEN 'M' ELSE 'N' END AS iupac,
           CASE pair WHEN 'AA' THEN 'A' WHEN 'CC' THEN 'C' WHEN 'GG' THEN 'G' WHEN 'TT' THEN 'T' ELSE 'N' END AS n FROM p""",
)
def _(spark, sf):
    letters = list("AcGutNx")
    pairs = spark.createDataFrame([(a, b) for a in letters for b in letters], "one string, two string")
    a, b = base(F.col("one")), base(F.col("two"))
    return pairs.select("one", "two", either_or(a, b).alias("iupac"), either_or(a, b, True).alias("n"))


@query("tsv_depth_order", _depth_sql(mate_fix=True, zeros=False))
def _(spark, sf):
    from covergrid.sources.sinks import ordered

    return ordered(only_depth(T.reads(spark, sf), T.contigs(spark), keep=KEEP, mate_fix=True, drop_zero_runs=True), T.contigs(spark))


@query(
    "region_processor_udtf",
    f"""WITH {_CTE} SELECT g.ref AS REF, CAST(g.start AS BIGINT) AS START, CAST(count(ord) AS BIGINT) AS READS FROM (SELECT ref, a AS start, least(a + 5000, length) AS stop FROM (SELECT ref, length, unnest(range(0, length, 5000)) AS a FROM contigs)) g
    LEFT JOIN (SELECT * FROM reads JOIN spans USING (cigar_text)) r ON r.ref = g.ref AND pos < g.stop AND pos + span > g.start GROUP BY ALL""",
)
def _(spark, sf):
    def count(region: dict, reads: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"REF": [region.get("ref")], "START": [region.get("start")], "READS": [len(reads)]})

    return _engine(spark, sf).run(count, "REF string, START bigint, READS bigint", chunksize=5000)


# ---- files: written from the tables, read back ----------------------------------------------------


def _text(df: DataFrame, column: str, path: str, name: str) -> str:
    """Writes a column as lines, in the order that df has; the folder's path."""
    df.select(F.col(column).alias("value")).write.text(f"{path}/{name}")
    return f"{path}/{name}"


def _sam(spark: SparkSession, sf: str) -> Engine:
    """The reads as a SAM file: header and records are files of one folder."""
    reads = T.reads(spark, sf)
    step = lambda x: F.concat(x["len"].cast("string"), x["op"])
    quals = F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")
    bare = F.length("seq") == 0
    line = F.concat_ws(
        "\t", "qname", F.col("flag").cast("string"), "ref", (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), F.array_join(F.transform("cigar", step), ""), F.lit("="),
        (F.col("mate_pos") + 1).cast("string"), F.col("tlen").cast("string"), F.when(bare, "*").otherwise(F.col("seq")), F.when(bare, "*").otherwise(quals),
    )
    header = T.contigs(spark).select(F.concat(F.lit("@SQ\tSN:"), "ref", F.lit("\tLN:"), F.col("length").cast("string")).alias("line"), "tid").coalesce(1).orderBy("tid")
    made = reads.select(line.alias("line"))
    from covergrid.sources import sinks

    folder = sinks.shared_folder(spark)
    header.select("line").write.text(f"{folder}/x.sam")
    made.write.mode("append").text(f"{folder}/x.sam")
    return Engine.open(spark, f"{folder}/x.sam")


@query("sam_reads", f"WITH {_CTE} SELECT qname, flag, tid, ref, CAST(pos AS BIGINT) AS pos, mapq, CAST(span AS BIGINT) AS span, mate_tid, CAST(mate_pos AS BIGINT) AS mate_pos, CAST(tlen AS BIGINT) AS tlen, seq, qual_text AS quals FROM reads JOIN spans USING (cigar_text)")
def _(spark, sf):
    digits = F.array_join(F.transform("qual", lambda q: F.substring(F.lit("0123456789abcdef"), (q / 3 + 1).cast("int"), F.lit(1))), "")
    return _sam(spark, sf).reads.select("qname", "flag", "tid", "ref", "pos", "mapq", cigar.span(F.col("cigar")).alias("span"), "mate_tid", "mate_pos", "tlen", F.coalesce("seq", F.lit("")).alias("seq"), digits.alias("quals"))


@query("sam_contigs", f"WITH {_CTE} SELECT tid, ref, CAST(length AS BIGINT) AS length FROM contigs")
def _(spark, sf):
    return _sam(spark, sf).contigs


@query("bed_and_vcf_regions", f"WITH {_CTE} SELECT ref, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM {_islands('(SELECT ref, start, stop FROM beds UNION ALL SELECT ref, start, stop FROM vcfs)')}")
def _(spark, sf):
    from covergrid.sources import sinks

    folder, engine = sinks.shared_folder(spark), _engine(spark, sf)
    beds = T.intervals(spark, sf).select(F.concat_ws("\t", "ref", F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("name")).alias("line"))
    sites = T.sites(spark, sf).select(F.concat_ws("\t", "ref", F.col("stop").cast("string"), F.lit("."), F.lit("A")).alias("line"))
    return engine.regions(_text(beds, "line", folder, "x.bed"), _text(sites, "line", folder, "x.vcf")).select("ref", "start", "stop")


@query("fasta_pieces", f"""WITH {_CTE} SELECT ref, CAST(p // 4096 AS BIGINT) AS piece, md5(string_agg(substr('ACGTacN', CAST((CAST(p AS BIGINT) * p + CAST(substr(ref, 4) AS INT) - 1) % 7 + 1 AS INT), 1), '' ORDER BY p)) AS digest FROM grid GROUP BY ALL""")
def _(spark, sf):
    from covergrid.sources import sinks, text

    lines = T.fasta(spark).select("ref", F.posexplode(F.expr("transform(sequence(0, (length(seq) - 1) div 61), i -> substring(seq, i * 61 + 1, 61))")).alias("i", "line"))
    named = T.contigs(spark).select("ref", F.lit(-1).alias("i"), F.concat(F.lit(">"), "ref", F.lit(" more")).alias("line"))
    path = _text(lines.union(named).orderBy("ref", "i"), "line", sinks.shared_folder(spark), "x.fa")
    return text.fasta_pieces(spark, path, 12).select("ref", "piece", F.md5("bases").alias("digest"))


@query("written_in_order", f"SELECT row_number() OVER (ORDER BY REF, POS) AS n, concat_ws(chr(9), REF, POS, \"END\", DEPTH) AS line FROM ({_depth_sql(zeros=False)}) UNION ALL SELECT 0, concat_ws(chr(9), 'REF', 'POS', 'END', 'DEPTH')")
def _(spark, sf):
    """The order of a written file's lines, of block-gzipped output under a name that Hadoop doesn't know."""
    from covergrid.sources import sinks, text

    path = f"{sinks.shared_folder(spark)}.tsv.bgzf"
    rows = only_depth(T.reads(spark, sf), T.contigs(spark), keep=KEEP, drop_zero_runs=True)
    sinks.write_bgzf(sinks.ordered(rows, T.contigs(spark)), path)
    numbered = text.lines(spark, path).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return numbered.select(F.row_number().over(Window.orderBy("id")).cast("bigint").alias("n"), "line").withColumn("n", F.col("n") - 1)


@query("tsv_merged", _MERGE.format(end='"END"', rows=f"SELECT * FROM ({_depth_sql(mate_fix=True, runs=False, zeros=False)})"))
def _(spark, sf):
    """Single positions written as a table, read back and merged."""
    from covergrid.sources import sinks, text

    path = sinks.shared_folder(spark)
    rows = only_depth(T.reads(spark, sf), T.contigs(spark), keep=KEEP, mate_fix=True, no_merge=True)
    sinks.write_tsv(rows, path)
    return M.merge_adjacent(text.intervals(spark, path))


@query("zero_row", "SELECT 'chr1' AS REF, CAST(1 AS BIGINT) AS POS, " + ", ".join(f'CAST(0 AS BIGINT) AS "{c}"' for c in COUNTS) + ", false AS NEAR_MAX_DEPTH")
def _(spark, sf):
    """What a position without reads is."""
    one = R.whole(T.contigs(spark).filter("tid = 0")).withColumn("stop", F.lit(1).cast("bigint"))
    return base_depth(T.reads(spark, sf).filter("false"), T.contigs(spark), one, keep_zeros=True)
