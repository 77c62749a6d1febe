import importlib
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from tessera import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_registered_queries_have_sql():
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["doc_id", "count"] and got.count() > 0


@pytest.mark.parametrize("name", ["q01_count_lines", "q04_positional_step", "q09_lines", "q13_hits_by_line", "q15_occurrence_bounds", "q16_attribute_types", "q20_lexical_types", "q21_line_edits", "q23_raw_ampersands", "q24_injected_faults", "q28_xpath_predicates", "q33_smart_fix", "q36_sizes", "q37_first_hit_as_of", "q17_table_mode", "q42_all_diagnostics", "q43_all_repairs", "q44_pretty_text", "q45_xpath_nodes", "q46_repeated_cells", "q47_index_size", "q48_first_attribute"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = lambda data, names: sorted(tuple(map(str, (r[names.index(c)] for c in columns))) for r in data)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """The subpackage and its pipeline may be deleted: nothing else imports them."""
    for item in ("tessera", "__spark_entry__.py"):
        source = os.path.join(ROOT, item)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / item, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / item)
    code = "import __spark_entry__ as e; names = e.queries(); assert 'q01_count_lines' in names and not any(n.startswith('op') or n == 'pipeline' for n in names); print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) == len(queries.ORACLE_SQL)
    assert importlib.import_module("tessera").__doc__
