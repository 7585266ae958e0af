import random
import re

import numpy as np
import pytest
import xxhash

from axiomill.llm import simhash
from axiomill.operators.components import connected_components
from tests.conftest import SMALL

from .helpers import docs, none, odd


def brute_mark(text, n):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("text", [None, "", "one", "Two Words", "a\x0bb\x1cc d e", "É é A a", "x " * 50, "the quick brown fox " * 9])
def test_fingerprint(text, monkeypatch):
    for n in (1, 3, 5):
        assert simhash.fingerprint(text, n) == brute_mark(text, n)
    monkeypatch.setattr(simhash, "word_slices", lambda raw: (raw.split()[i : i + 2] for i in range(0, len(raw.split()), 2)))
    assert simhash.fingerprint(text, 3) == brute_mark(text, 3)


@pytest.mark.parametrize("k", [1, 2])
def test_links_connect_what_all_pairs_connect(spark, k):
    rng = random.Random(k)
    marks = {0, 2**64 - 1}
    for _ in range(40):
        center = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            x = center
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                x ^= 1 << b
            marks.add(x)
            center = rng.choice([center, x])
    signed = {x: int(np.uint64(x).view(np.int64)) if x else 0 for x in marks}
    nodes = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    links = simhash.links(nodes, k)
    pairs = [(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= k]
    want = groups(list(signed.values()), [(signed[a], signed[b]) for a, b in pairs])
    assert groups(list(signed.values()), [tuple(r) for r in links.collect()]) == want
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {x: r for x, r in want.items() if x != r}


def test_large_postings_are_linked_as_small_ones():
    rng = np.random.default_rng(3)
    free = 0xFFFF
    for n in (2, 50, 256, 257, 700):
        values = np.unique(rng.integers(0, 1 << 16, n).astype(np.uint64))
        root = simhash.linked(values, 2, free)
        pairs = [(int(a), int(b)) for i, a in enumerate(values) for b in values[:i] if (int(a) ^ int(b)).bit_count() <= 2]
        assert dict(zip(values.tolist(), root.tolist(), strict=True)) == groups(values.tolist(), pairs)


def test_operator_on_the_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    mark = {r.doc_id: brute_mark(r.text, 3) for r in df.collect()}
    want = groups(list(mark), [(a, b) for a in mark for b in mark if a < b and (mark[a] ^ mark[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, words=3, bits=2).collect()}
    assert got == {d: (f"{m:016x}", want[d]) for d, m in mark.items()}


def test_odd_tables(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == 12
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[3, "0" * 16] == by[4, "0" * 16] == 3 and by[None, "0" * 16] == 3
    assert simhash.near_duplicates(none(spark)).collect() == []
    assert simhash.near_duplicates(docs(spark, ["a b c d e f"])).collect()[0].component_id == 0


def test_the_tally_counts_equal_bytes():
    rng = random.Random(9)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(200)] + [(0, 0), (5, 4), (2**63, 2**63 + 256)]
    x = np.array([a ^ b for a, b in pairs], np.uint64)
    equal = [sum(p == q for p, q in zip(a.to_bytes(8), b.to_bytes(8), strict=True)) for a, b in pairs]
    assert simhash.shared_bytes(x).tolist() == equal
    assert simhash.verified(x, 2).tolist() == [e >= 6 and (a ^ b).bit_count() <= 2 for e, (a, b) in zip(equal, pairs, strict=True)]


def test_the_tally_turns_away_most_of_those_that_meet():
    rng = np.random.default_rng(8)
    values = np.unique(rng.integers(0, 1 << 32, 250, dtype=np.uint64) << np.uint64(32) | np.uint64(0x1234_5678))
    values = np.concatenate([values, values[:20] ^ np.uint64(3 << 40), values[:20] ^ np.uint64(1 << 35 | 1 << 50)])
    x = values[:, None] ^ values[None, :]
    x = x[np.triu_indices(len(values), 1)]
    shared = simhash.shared_bytes(x)
    assert shared.min() >= 4 and (shared < 6).mean() > 0.95
    assert simhash.verified(x, 2).tolist() == [n >= 6 and int(v).bit_count() <= 2 for n, v in zip(shared, x, strict=True)] and simhash.verified(x, 2).sum() >= 40


@pytest.mark.parametrize("large", [2, 30, 1 << 16])
def test_large_groups_of_bytes_go_on_to_smaller_postings(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(large)
    marks = sorted({0xABCD_EF01 << 32 | rng.getrandbits(12) << 8 * rng.randrange(3) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [int(np.uint64(x).view(np.int64)) for x in marks]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2)
    pairs = [(signed[i], signed[j]) for i, a in enumerate(marks) for j, b in enumerate(marks[:i]) if (a ^ b).bit_count() <= 2]
    assert groups(signed, [tuple(r) for r in links.collect()]) == groups(signed, pairs) and len(pairs) > 20
