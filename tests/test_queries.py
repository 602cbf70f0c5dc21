"""Every registered query of the motion operators against its SQL in DuckDB, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__
from motionloom.plans import queries as motion


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(motion.SQL))
def test_query_agrees_with_sql(name, spark, sf_dir, duck):
    df = motion.QUERIES[name](spark, sf_dir)
    found = duck.execute(motion.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(motion.QUERIES) - set(motion.SQL)))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert motion.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_imports_without_the_corpus_operators(tmp_path):
    """The folders of the corpus operators can be deleted; everything else stays."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__spark_entry__.__file__).parent
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    shutil.copytree(top / "motionloom", tmp_path / "motionloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
