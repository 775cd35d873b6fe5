"""Every registered query of the graph engine against DuckDB on the smallest tables, and without the training-data subpackage."""

from __future__ import annotations

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from cairngraph.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(columns, rows):
    """Rows in the order of their columns' names; whole numbers and others are told apart."""
    cell = lambda v: str(round(v + 0.0, 5)) if isinstance(v, float) else f"{type(v).__name__} {v}"
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.columns, got) == plain(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_llm(tmp_path):
    """The driver's contract and the other tests hold when the training-data subpackage, its tests and the pipeline aren't there."""
    import shutil

    for p in ("cairngraph", "tests", "__spark_entry__.py", "bench.py"):
        src = os.path.join(ROOT, p)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / p)
    for p in ("cairngraph/llm", "tests/llm"):
        shutil.rmtree(tmp_path / p, ignore_errors=True)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hotspots' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
    some = [sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_catalogue.py", "-k", "lookup or store or entry"]
    subprocess.run(some, cwd=tmp_path, env=env, check=True, timeout=600)
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout[-2000:]


def test_without_a_library(tmp_path):
    """A library that only the training-data operators need may be missing."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert 'hotspots' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, check=True, timeout=120)
