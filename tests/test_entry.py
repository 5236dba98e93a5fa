"""The driver's entry module, with and without the optional subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_queries_and_sql_agree_on_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(here):
        if name not in ("corpus_pipeline.py", "covergrid", ".git", "tests"):
            os.symlink(f"{here}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "covergrid")
    for name in os.listdir(f"{here}/covergrid"):
        if name != "llm":
            os.symlink(f"{here}/covergrid/{name}", tmp_path / "covergrid" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'base_depth' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["only_depth_mate_fix", "base_depth_mate_iupac", "merge_adjacent", "regions_union", "sam_reads", "bed_and_vcf_regions", "fasta_pieces", "written_in_order", "tsv_merged"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, rel.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).columns == ["REF", "POS", "END", "DEPTH"]
