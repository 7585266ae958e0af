"""Closures against plain search: from scratch, extended and retracted."""

import random

import pytest

from axiomill.operators import components, fixpoint


def slow(links):
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in out:
        todo, seen = list(out[start]), set(out[start])
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        found |= {(start, b) for b in seen}
    return found


def frame(spark, links):
    return spark.createDataFrame(sorted(links, key=repr), "a long, b long")


def pairs(c):
    rows = [tuple(r) for r in c.pairs.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def graph(seed, nodes=14, n=22):
    rng = random.Random(seed)
    return {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)}


@pytest.mark.parametrize("seed", range(3))
def test_closure_extended_and_retracted_equal_search_from_scratch(spark, seed):
    rng, links = random.Random(seed), graph(seed)
    full = fixpoint.closure(frame(spark, links))
    assert pairs(full) == slow(links) == pairs(fixpoint.closure(frame(spark, links), linear=True))
    more = graph(seed + 100, n=6)
    assert pairs(fixpoint.extended(full, frame(spark, more))) == slow(links | more)
    less = set(rng.sample(sorted(links), 5))
    assert pairs(fixpoint.retracted(full, frame(spark, links), frame(spark, less))) == slow(links - less)
    assert pairs(full) == slow(links)


def test_other_ways_bring_pairs_back(spark):
    links = {(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (3, 5), (5, 6)}
    got = fixpoint.retracted(fixpoint.closure(frame(spark, links)), frame(spark, links), frame(spark, {(1, 2), (7, 8)}))
    assert pairs(got) == slow(links - {(1, 2)}) and (0, 6) in pairs(got)


def test_extension_after_retraction(spark):
    links = {(i, i + 1) for i in range(12)}
    cut = fixpoint.retracted(fixpoint.closure(frame(spark, links)), frame(spark, links), frame(spark, {(5, 6)}))
    assert pairs(fixpoint.extended(cut, frame(spark, {(5, 6)}))) == slow(links)


def test_rounds_tell_that_paths_double(spark):
    chain = fixpoint.closure(frame(spark, {(i, i + 1) for i in range(16)}))
    assert [(k, new) for k, _, new in chain.told] == [(0, 16), (1, 15), (2, 14 + 13), (3, 12 + 11 + 10 + 9), (4, sum(range(1, 9))), (5, 0)]
    assert len(fixpoint.closure(frame(spark, {(i, i + 1) for i in range(16)}), linear=True).told) == 17
    assert chain.rounds.count() == 6


def test_an_extension_derives_from_what_is_new_alone(spark):
    far = {(i, i + 1) for i in range(0, 40) if i % 10 != 9}
    full = fixpoint.closure(frame(spark, far))
    more = fixpoint.extended(full, frame(spark, {(100, 101), (101, 102)}))
    assert [new for _, _, new in more.told[len(full.told) :]] == [2, 1, 0]


def test_empty_null_and_repeated_links(spark):
    assert pairs(fixpoint.closure(frame(spark, set()))) == set()
    rows = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (2, None), (2, 1)], "a long, b long")
    assert pairs(fixpoint.closure(rows)) == {(1, 2), (2, 1), (1, 1), (2, 2)}
    assert pairs(fixpoint.extended(fixpoint.closure(frame(spark, set())), rows)) == {(1, 2), (2, 1), (1, 1), (2, 2)}
    names = spark.createDataFrame([("x", "y"), ("y", "z")], "a string, b string")
    assert {tuple(r) for r in components.transitive_closure(names).collect()} == {("x", "y"), ("y", "z"), ("x", "z")}


def test_a_chain_is_derived_once_a_pair(spark):
    links = {(i, i + 1) for i in range(16)}
    chain = fixpoint.closure(frame(spark, links))
    assert pairs(chain) == slow(links) and all(derived == new for _, derived, new in chain.told)


def test_loops_and_ways_of_different_length(spark):
    links = {(0, 0), (0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5), (5, 6), (6, 2), (7, 8), (8, 7)}
    assert pairs(fixpoint.closure(frame(spark, links))) == slow(links)
