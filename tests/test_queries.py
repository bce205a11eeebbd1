"""Every query against its SQL, and the repository without its llm parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from postflock.plans import oracle, queries

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_same_as_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    want = tables.execute(oracle.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*names).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracle.ORACLE_SQL)


def test_one_scan_for_all_text_features(spark):
    plan = queries.entry(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 1 and plan.count("documents.parquet") == 1 and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_llm(tmp_path, gone):
    """With the llm folders deleted, with the pipeline or without it, all else is
    there, and its other tests can be collected and pass."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; print(len(e.queries()), len(e.oracle_sql()))"
    env = {"PATH": os.environ["PATH"], "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(queries.QUERIES)), str(len(oracle.ORACLE_SQL))]
    tests = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_text.py", "tests/test_operators.py"] if len(gone) == 1 else [sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=copy, capture_output=True, text=True, env=env)
    assert tests.returncode == 0, tests.stdout[-2000:]
