"""The driver contract, also without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e

ROOT = Path(__file__).parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90


def test_a_missing_package_takes_the_subpackage_only():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'monthly_volume' in q and not any(k.startswith('op') for k in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_imports_without_the_subpackage():
    code = "import sys; sys.modules['threadline.llm'] = None; import __spark_entry__ as e; assert 'monthly_volume' in e.queries() and not any(k.startswith('op1') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


@pytest.mark.skipif(not DATA.exists(), reason="needs the supplied tables")
def test_flagship(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the supplied tables")
@pytest.mark.parametrize("name", ["monthly_volume", "community_stats", "clean_text_rows", "predicate_flags", "thread_flatten", "top_bigrams", "cluster_evolution", "stream_window_counts"])
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = e.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    norm = lambda v: round(v, 5) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    rel = con.sql(e.oracle_sql()[name])
    want = sorted(repr([norm(r[rel.columns.index(c)]) for c in cols]) for r in rel.fetchall())
    assert sorted(repr([norm(r[c]) for c in cols]) for r in df.collect()) == want
