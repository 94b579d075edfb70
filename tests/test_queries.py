import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from buildloom import queries

ROOT = Path(__file__).resolve().parents[1]
SAMPLE = ["stats_overview", "timeline", "source_reads_by_ext", "tools_by_package", "external_libs", "project_sources_relative", "artifacts_by_ext", "tree_two_levels", "headers_top15", "fd_sessions", "section_strip", "git_blob_hash", "sparql_external_libs", "sparql_children", "sparql_correlated", "log_edges", "rendered_cmdline", "bench_compare", "build_plan", "turtle_lists"]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def test_every_query_has_an_oracle():
    assert queries.queries().keys() == queries.oracle_sql().keys()


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, sf_dir, oracle, name):
    got = queries.queries()[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = oracle.execute(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    """Column pruning and filters on stored property tables."""
    from buildloom.plans import model, reports
    from buildloom.sources import projection

    model.save(projection.graph(spark, sf_dir), str(tmp_path))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the scan's filters are shortened in the text
    try:
        plan = reports.external_libs(model.load(spark, str(tmp_path)))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "StringStartsWith(abspath,/lib)" in plan and "StringContains(abspath,.so)" in plan and "LeftAnti" in plan


def test_entry_without_the_corpus_operators(tmp_path):
    """Taken out, the rest still imports and has its queries."""
    for p in ROOT.iterdir():
        if p.name not in ("buildloom", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "buildloom").mkdir()
    for p in (ROOT / "buildloom").iterdir():
        if p.name != "llm":
            (tmp_path / "buildloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'external_libs' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
