"""Every registered query agrees with its SQL on the smallest tables, where those are present."""

import os

import pytest

import __spark_entry__ as entry_module
from conformance.check import TABLES, digest

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SAMPLE = [
    "hl10_chronic_results", "fa05_snapshot", "lg02_longitudinal", "ma03_match_everyone", "tp15_load_periods_in_range", "fa09_siblings",
    "ma03_match", "tp15_load_with_catalogue", "sc15_two_upserts", "lg01_fold_latest", "pe05_residency_own_date", "lg08_overlap_join", "fi25_code_list",
    "ba04_several_comparisons", "hl06_categorize",
]
# All of them with ``LIFEFRAME_EVERY_QUERY=1``; the conformance check runs them on larger tables.
if os.environ.get("LIFEFRAME_EVERY_QUERY"):
    SAMPLE = sorted(entry_module.ORACLES)


def test_registrations():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(entry_module.QUERIES) == set(entry_module.ORACLES)


@needs_tables
def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    ours = entry_module.queries()[name](spark, SF).toArrow()
    theirs = con.execute(entry_module.oracle_sql()[name]).to_arrow_table()

    def of(t):
        return digest(t.column_names, list(zip(*(c.to_pylist() for c in t.columns))) if t.num_rows else [])

    assert of(ours) == of(theirs)


def test_entry_without_the_training_data_operators(tmp_path):
    """The library, the queries and their SQL work without the subpackage and its pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    for name in ("lifeframe", "conformance"):
        shutil.copytree(os.path.join(root, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(entry_module.QUERIES)), str(len(entry_module.ORACLES))], said.stderr[-500:]
