"""Every query with SQL gives the same rows as DuckDB; the others, which tests of values cover, run over whole tables."""

import os

import duckdb
import pytest

from segmenta import queries as q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", list(q.SQL))
def test_equals_sql(spark, duck, name):
    df = q.FOUND[name](spark, D)
    columns = sorted(df.columns)
    want = duck.sql(q.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    order = [names.index(x) for x in columns]
    got = sorted((plain(r[x] for x in columns) for r in df.collect()), key=repr)
    assert got == sorted((plain(r[i] for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", [n for n in q.FOUND if n not in q.SQL])
def test_gives_rows(spark, name):
    assert q.FOUND[name](spark, D).count() > 0


def test_missing_libraries_of_the_training_operators(tmp_path):
    """Without a library that they import the other queries still work."""
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "xxhash.py").write_text("raise ImportError")
    code = "import __spark_entry__ as e; assert 'exact_match' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    root = Path(__file__).parents[1]
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{root}"})


def test_works_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "segmenta", tmp_path / "segmenta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'exact_match' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
