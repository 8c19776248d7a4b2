"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, duck, name):
    ours, theirs = entry.queries()[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    own = sorted(ours.columns)
    assert sorted(ours[own].astype(str).itertuples(index=False, name=None)) == sorted(theirs[own].astype(str).itertuples(index=False, name=None))


def test_every_query_is_a_function_of_session_and_folder():
    assert set(SQL) <= set(entry.queries()) and all(map(callable, entry.queries().values()))


def test_flagship(spark):
    assert entry.entry(spark).count() == 20


def test_entry_works_without_the_training_data_package(tmp_path):
    """As when the folders of that package are deleted."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "quillspark"), tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    n, sql = map(int, out.stdout.split())
    assert n >= 50 and sql >= 45
