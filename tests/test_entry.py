"""The registry, and each query against its SQL on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as collections

DATA = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(collections.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    df = collections.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(map(plain, r)) for r in db.execute(f"SELECT {quoted} FROM ({collections.ORACLE[name]}) q").fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "value", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_works_without_the_training_data_operators(tmp_path, pipeline):
    """A whole copy without the two folders, with and without the pipeline's file: the entry module and the other tests work."""
    for name in ("tidemark", "tests", "__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        src = os.path.join(HERE, name)
        if os.path.exists(src):
            (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    for name in ("tidemark", "tests"):
        shutil.rmtree(tmp_path / name / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'map_upsert' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert set(e.oracle_sql()) == set(e.queries())"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)
    run = [sys.executable, "-B", "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider"]
    subprocess.run([*run, "--collect-only", "tests"], cwd=tmp_path, env=env, check=True, stdout=subprocess.DEVNULL)
    if pipeline:
        subprocess.run([*run, "tests/test_entry.py::test_entry", "tests/test_keyed.py::test_bounds_of_one_hot_key"], cwd=tmp_path, env=env, check=True)
