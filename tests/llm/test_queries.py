"""The queries of the subpackage that have SQL, against DuckDB on the small tables."""

import duckdb
import pytest

from axiomill.llm import queries, sql
from tests.conftest import SMALL
from tests.test_queries import TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = queries.queries()[name](spark, SMALL)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr) and got


def test_a_query_for_each_operator():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_the_hash_in_sql_is_xxh64():
    import xxhash

    texts = ["é ß 😀 a longer text "[: 1 + i % 20] * (1 + i // 7) for i in range(120)] + [""]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [[x] for x in dict.fromkeys(texts)])
    got = dict(con.sql(f"WITH {sql._xxh64('t', 42)} SELECT s, h FROM xx").fetchall())
    assert got == {x: xxhash.xxh64_intdigest(x.encode(), seed=42) for x in texts}
