"""Every query with SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from axiomill import queries
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    v = float(v)
    return "nan" if math.isnan(v) else round(v, 6)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_the_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    rel = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr) and got


def test_the_entry_imports_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/axiomill", tmp_path / "axiomill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'split_counts' in e.queries() and not [n for n in e.queries() if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_but_the_entry_knows_the_llm_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{root}/axiomill"):
        if "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "axiomill.llm" not in open(f"{folder}/{f}").read(), f
