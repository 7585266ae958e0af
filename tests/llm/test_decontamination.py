import hashlib
import random
import re

import numpy as np
import pytest

from axiomill.llm import decontamination as d

from .helpers import docs, none, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, window):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for j, t in texts.items():
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in windows}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[p]
        out[j] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("window, vocabulary, pass_bytes, shard", [(10, 3, 1 << 20, 1 << 20), (4, 5, 100, 1 << 20), (3, 9, 1 << 20, 50)])
def test_hits_are_those_of_comparing_all_windows(spark, monkeypatch, window, vocabulary, pass_bytes, shard):
    monkeypatch.setattr(d, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(d, "SHARD_WORDS", shard)
    rng = random.Random(window)
    vocab = ["the", "Über", "a1", "x", "of", "AND", "é", "zz", "q9", "rare", "odd"]
    text = lambda n, v: "".join(rng.choice(vocab[:v]) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    texts = {i: text(rng.randrange(0, 60), vocabulary + 2) for i in range(120)}
    items = [(i, text(rng.choice([0, 1, window - 1, window, window + 5]), vocabulary)) for i in range(10)] + [(3, "x of and")]
    texts[500] = " ".join([items[4][1]] * 3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in d.decontaminate(docs(spark, list(texts.values()), list(texts)), bench, window=window).collect()}
    assert got == brute(texts, items, window)
    kept = {r.doc_id for r in d.drop_contaminated(docs(spark, list(texts.values()), list(texts)), bench, window=window).collect()}
    assert kept == {j for j, x in got.items() if not x[4]}


def test_index_finds_and_locates_every_occurrence():
    rng = np.random.default_rng(1)
    for size in (1, 5, 200, 3000):
        seq = rng.integers(0, 5, size)
        seq[-1] = 0
        index = d.FMIndex(seq, 7)
        assert sorted(d.suffix_array(seq).tolist()) == list(range(size))
        for n in (1, 2, 4):
            phrases = rng.integers(1, 8, (20, n))
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi, strict=True):
                want = [i for i in range(size - n + 1) if (seq[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_odd_tables(spark):
    bench = spark.createDataFrame([(None, "same text here"), (1, None), (2, "")], "item_id long, text string")
    got = d.decontaminate(odd(spark), bench).collect()
    assert len(got) == 12 and sum(r.contaminated for r in got) == 2
    assert d.decontaminate(none(spark), bench).collect() == []
    assert not any(r.contaminated for r in d.decontaminate(odd(spark), bench.limit(0)).collect())
    assert len(d.drop_contaminated(odd(spark), bench).columns) == 15


def test_repeated_benchmark_rows_are_held_once(spark):
    bench = spark.createDataFrame([(1, "some words of a test")] * 500, "item_id long, text string")
    passes = list(d._passes(bench, "text", "item_id", 10))
    assert len(passes) == 1 and sum(len(w) for _, w in passes[0][1].by_length.values()) == 1
    assert d.Phrases([]).shortest == 0 and d.Phrases([("a", "x y")]).items_of(np.array([0])) == ["a"]
