import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from axiomill.llm import periodic_runs as p
from tests.conftest import SMALL

from .helpers import docs, none, odd


def slow_runs(w):
    """All stretches of every period, word by word; those with a shorter period go."""
    n, out = len(w), []
    for q in range(1, n // p.PERIODS + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(p.LEAST, p.PERIODS * q) and not any(all(w[start + k] == w[start + k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out)


def made(rng):
    n = rng.randrange(0, 120)
    w = [rng.randrange(rng.choice([1, 2, 2, 3, 6])) for _ in range(n)]
    for _ in range(rng.randrange(5)):
        if n > 10:
            s, q = rng.randrange(n - 4), rng.randrange(1, 14)
            for i in range(s + q, min(n, s + q * rng.randrange(3, 9) + rng.randrange(q))):
                w[i] = w[i - q]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(500):
        w = made(rng)
        assert p.word_runs(np.array(w, np.int32)) == slow_runs(w), w


def test_runs_over_chunks_and_nested_periods():
    w = np.tile(np.arange(37), 5000)
    assert p.word_runs(w) == [(0, len(w), 37)]
    w[100_000] = 99
    assert p.word_runs(w) == [(0, 100_000, 37), (100_001, len(w) - 100_001, 37)]
    inner = ([0] * 8 + [1]) * 5
    assert p.word_runs(np.array(inner)) == slow_runs(inner) and len(slow_runs(inner)) == 6


def answer(doc, text):
    """The query's row for one document, from the contract."""
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is not None and h % 10 == 0 and n:
        a, k = h // 10 % n, h // 10 % 8
        q = 1 + (n - a) // (3 + k)
        w = [w[i] if i < a else w[a + (i - a) % q] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc, len(runs), *longest, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def rows(spark, df):
    return sorted((tuple(r) for r in p.run_digests(p.periodic_runs(df, rewrite=p.implanted)).collect()), key=repr)


def test_rows_are_those_of_the_contract(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").limit(200)
    short = [r for r in df.collect() if len(r.text) < 20_000]
    want = sorted((answer(r.doc_id, r.text) for r in short), key=repr)
    assert rows(spark, df.where("length(text) < 20000")) == want and any(r[1] for r in want)


def test_odd_tables(spark):
    df = odd(spark)
    short = df.where("coalesce(length(text), 0) < 9999")
    assert rows(spark, short) == sorted((answer(r.doc_id, r.text) for r in short.collect()), key=repr)
    got = {(r[0], r[1]) for r in rows(spark, df)}
    assert (3, 0) in got and (4, 0) in got and (5, 1) in got and len(rows(spark, df)) == 12
    assert rows(spark, none(spark)) == []


def test_collapsed_text_and_marks(spark):
    df = docs(spark, ["x " + "a b c " * 5 + "y", "one two", None], ids=[3, 4, 5])
    got = {r.doc_id: r for r in p.periodic_runs(df).collect()}
    assert got[3].collapsed == "x a b c y" and [tuple(r) for r in got[3].runs] == [(1, 15, 3)]
    assert got[4].collapsed == "one two" and got[5].collapsed == "" and got[5].n_words == 0


def test_bytes_that_are_no_utf8(spark):
    df = spark.sql("SELECT 3L AS doc_id, CAST(unhex('FF20FF20FF20FF20FF20FF20C3') AS STRING) AS text")
    got = p.periodic_runs(df).selectExpr("runs", "hex(CAST(collapsed AS BINARY)) AS kept").first()
    assert [tuple(r) for r in got.runs] == [(0, 6, 1)] and got.kept == "FF20C3"
