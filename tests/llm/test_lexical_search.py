import math
import random
import re
from collections import Counter

import pytest

from axiomill.llm import lexical_search as s
from tests.conftest import SMALL

from .helpers import docs, none, odd

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(documents, queries, best=50):
    """Every query against every document."""
    held = [(i, Counter(terms(t))) for i, t in documents]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c in held:
            m = 50 + (50 * c.total() * n_docs) // max(1, n_terms)
            total = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if total > 0:
                scored.append((-total, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:best], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), "item_id long, text string")


def test_rows_are_those_of_brute_force(spark):
    df, q = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = slow([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in q.collect()])
    assert rows(s.search(df, q)) == want and want


@pytest.mark.parametrize("window,task_rows,pass_bytes", [(8, 16, 1 << 20), (16, 1 << 18, 300), (1 << 14, 10, 60)])
def test_windows_tasks_and_blocks_do_not_change_the_rows(spark, monkeypatch, window, task_rows, pass_bytes):
    monkeypatch.setattr(s, "WINDOW", window)
    monkeypatch.setattr(s, "TASK_ROWS", task_rows)
    rng = random.Random(window)
    word = lambda: "w" + str(min(rng.randrange(40), rng.randrange(40)))
    documents = [(rng.choice([i, -i, i * 1_000_003, 5]), " ".join(word() for _ in range(rng.randrange(30)))) for i in range(300)]
    queries = [(k, " ".join(word() for _ in range(rng.randrange(6)))) for k in range(25)]
    df = docs(spark, [t for _, t in documents], ids=[i for i, _ in documents])
    got = rows(s.search(df, items(spark, [t for _, t in queries]), best=7, pass_bytes=pass_bytes))
    assert got == slow(documents, queries, 7)


def test_ties_come_by_ascending_id_and_the_missing_one_last(spark):
    df = docs(spark, ["same words"] * 60 + ["other"], ids=[*range(59, 0, -1), None, 99])
    got = s.search(df, items(spark, ["words"]), best=60).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [*range(1, 60), None] and [r["rank"] for r in got] == list(range(1, 61))


def test_odd_tables(spark):
    q = items(spark, ["The QUICK fox", None, "", "text ß", "text ß", "zzz"], ids=[1, 2, 3, None, None, 4])
    df = odd(spark)
    assert rows(s.search(df, q)) == slow([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in q.collect()])
    assert rows(s.search(none(spark), q)) == [] and rows(s.search(df, q.limit(0))) == []


def test_bytes_that_are_no_utf8(spark):
    df = spark.sql("SELECT 3L AS doc_id, CAST(unhex('6162FF20') AS STRING) AS text UNION ALL SELECT 4L, 'zz'")
    q = spark.sql("SELECT 1L AS item_id, CAST(unhex('4142FF') AS STRING) AS text")
    assert [r.doc_id for r in s.search(df, q).collect()] == [3]
