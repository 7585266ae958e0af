"""Merge forests and derivation graphs against plain search over small random graphs."""

import itertools
import random

import pytest

from axiomill.operators import derivations as dv
from axiomill.operators import merges


def classes(links):
    """node -> smallest node of its class."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, *_ in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root if find(x) != x}


def made(seed, nodes=18, n=40):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes), rng.randrange(6)) for _ in range(n)]


@pytest.fixture(params=range(2))
def graph(request, spark):
    rows = made(request.param)
    return rows, spark.createDataFrame(rows + [(None, 1, 2), (1, 2, None), (3, 3, 0)], "a long, b long, level int")


def test_forest_and_classes_at_every_level(spark, graph):
    rows, df = graph
    forest = [tuple(r) for r in merges.merge_forest(df).collect()]
    known = {(min(a, b), max(a, b), n) for a, b, n in rows}
    assert set(forest) <= known and len(forest) == len(classes(rows))
    for upto in range(8):
        assert classes([r for r in forest if r[2] < upto]) == classes([r for r in rows if r[2] < upto])
    got = merges.classes_upto(spark.createDataFrame(forest, "a long, b long, level int"), [4, 0, 2, 7]).collect()
    for upto in (0, 2, 4, 7):
        assert {r.node: r.root for r in got if r.upto == upto} == classes([r for r in rows if r[2] < upto])


def test_paths_are_shortest_and_below_the_level(spark, graph):
    rows, df = graph
    asks = [(k, x, y, upto) for k, (x, y, upto) in enumerate(itertools.product(range(0, 18, 5), range(1, 18, 4), (2, 5)))]
    got = merges.merge_paths(df, spark.createDataFrame([*asks, (99, 1, None, 3), (98, 2, 2, 3)], "ask long, x long, y long, upto int")).collect()
    for k, x, y, upto in asks:
        near = {}
        for a, b, n in rows:
            if n < upto and a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        dist, todo = {x: 0}, [x]
        for at in todo:
            for b in sorted(near.get(at, ())):
                if b not in dist:
                    dist[b] = dist[at] + 1
                    todo.append(b)
        way = sorted((r.step, r.a, r.b, r.level) for r in got if r.ask == k)
        assert len(way) == (dist.get(y, 0) if x != y else 0)
        assert [w[1] for w in way[:1]] == [y] * bool(way) and all(p[2] == q[1] for p, q in itertools.pairwise(way)) and all(w[3] < upto and w[2] in near[w[1]] for w in way)
        assert not way or way[-1][2] == x
    assert not [r for r in got if r.ask in (98, 99)]


def test_no_links(spark):
    none = spark.createDataFrame([], "a long, b long, level int")
    assert merges.merge_forest(none).collect() == [] == merges.classes_upto(none, [3]).collect() == merges.classes_upto(none, []).collect()
    assert merges.merge_paths(none, spark.createDataFrame([(1, 1, 2, 3)], "ask long, x long, y long, upto int")).collect() == []


STEPS = "step long, head string, premises array<string>, weight long"


def least(rows):
    best, moved = {}, True
    while moved:
        moved = False
        for _, head, premises, weight in rows:
            use = {p for p in premises or [] if p is not None}
            if use <= best.keys():
                cost = max(weight or 0, 1 if use else 0) + sum(best[p] for p in use)
                if cost < best.get(head, cost + 1):
                    best[head], moved = cost, True
    return best


@pytest.mark.parametrize("seed", range(2))
def test_least_weights_and_explanations(spark, seed):
    rng = random.Random(seed)
    names = "abcdefghijklm"
    rows = [(i, rng.choice(names), [rng.choice(names) for _ in range(rng.choice([1, 2, 2, 3]))], rng.randrange(6)) for i in range(40)]
    rows += [(100, "a", [], 3), (101, "b", None, 2), (102, "a", [None], 2), (103, "c", [], 0), (104, "d", [], 1), (105, "e", [], 4), (106, "f", [], 9)]
    df = spark.createDataFrame(rows, STEPS)
    got = {r.fact: r for r in dv.least_weights(df).collect()}
    want, by = least(rows), {r[0]: r for r in rows}
    assert {f: r.value for f, r in got.items()} == want and len(want) > 5

    def cost(fact, above=()):
        assert fact not in above
        _, head, premises, weight = by[got[fact].step]
        use = {p for p in premises or [] if p is not None}
        assert head == fact
        return max(weight or 0, 1 if use else 0) + sum(cost(p, (*above, fact)) for p in use)

    assert all(cost(f) == want[f] for f in want)

    def rests(fact):
        return {fact}.union(*(rests(p) for p in by[got[fact].step][2] or [] if p is not None))

    told = dv.explanation(df, dv.least_weights(df), spark.createDataFrame([(f,) for f in [*names[:4], "zz"]], "fact string")).collect()
    assert {(r.goal, r.fact) for r in told} == {(g, f) for g in names[:4] if g in want for f in rests(g)}


def test_a_proof_that_is_cheaper_though_it_is_found_later(spark):
    rows = [(1, "goal", ["x"], 50), (2, "x", [], 1), (3, "goal", ["p3"], 1), (4, "p3", ["p2"], 1), (5, "p2", ["p1"], 1), (6, "p1", [], 1), (7, "p1", ["goal"], 1)]
    got = {r.fact: (r.value, r.step) for r in dv.least_weights(spark.createDataFrame(rows, STEPS)).collect()}
    assert got == {"x": (1, 2), "p1": (1, 6), "p2": (2, 5), "p3": (3, 4), "goal": (4, 3)}


def test_dependency_difference(spark):
    steps = spark.createDataFrame([("p", "goal", ["s1", "x"]), ("p", "x", ["s2", "aux1"]), ("p", "unused", ["s3"]), ("q", "goal", ["s1"])], "problem string, head string, premises array<string>")
    facts = spark.createDataFrame([("p", "goal", ["a", "d"]), ("p", "s1", ["a", "b"]), ("p", "s2", ["c"]), ("p", "aux1", ["a", "e"]), ("p", "s3", ["e"]), ("p", "x", ["e"]), ("q", "goal", ["a"]), ("q", "s1", ["b"])], "problem string, fact string, args array<string>")
    points = spark.createDataFrame([("p", "d", ["b", "c"]), ("p", "c", ["d"]), ("p", "e", ["a"]), ("q", "a", [])], "problem string, point string, rely_on array<string>")
    goals = spark.createDataFrame([("p", "goal"), ("q", "goal")], "problem string, fact string")
    got = {tuple(r) for r in dv.dependency_difference(steps, facts, points, goals).collect()}
    assert got == {("p", "goal", "goal"), ("p", "x", "proof"), ("p", "s1", "setup"), ("p", "s2", "setup"), ("p", "aux1", "auxiliary"), ("q", "goal", "goal"), ("q", "s1", "auxiliary")}


def test_layers_are_longest_paths(spark):
    rng = random.Random(3)
    rows = [("p", i, sorted({rng.randrange(i) for _ in range(rng.randrange(3))})) for i in range(1, 25)]
    deep = {0: 0}
    for _, i, premises in rows:
        deep[i] = 1 + max((deep[p] for p in premises), default=-1)
    df = spark.createDataFrame(rows, "problem string, head long, premises array<long>")
    got = {r.fact: r.layer for r in dv.layers(df).collect()}
    assert got == {k: v for k, v in deep.items() if k in got} and set(got) >= set(range(1, 25))
    with pytest.raises(RuntimeError, match="cycle"):
        dv.layers(spark.createDataFrame([("p", 1, [2]), ("p", 2, [1])], "problem string, head long, premises array<long>"), most_rounds=6)


def test_shortened_proofs(spark):
    rows = [("t1", ["s1", "s2"], True, False), ("t2", ["t1", "s3"], True, False), ("n1", ["s4"], False, False), ("n2", ["s4"], False, False), ("k", ["s5"], True, False), ("n3", ["k", "n1"], False, False), ("goal", ["t2", "n3", "n2"], True, True), ("axiom", [], True, False), ("t3", ["axiom"], True, False), ("n4", ["n1", "n2"], False, False), ("end", ["t3"], True, True)]
    df = spark.createDataFrame([("p", *r) for r in rows], "problem string, head string, premises array<string>, trivial boolean, last boolean")
    got = {(tuple(r.heads), tuple(r.premises)) for r in dv.shortened(df).collect()}
    assert got == {(("n1", "n2"), ("s4",)), (("k",), ("s5",)), (("n3",), ("k", "n1")), (("goal",), ("n2", "n3", "s1", "s2", "s3")), (("n4",), ("n1", "n2")), (("end",), ())}
    all_in = {(tuple(r.heads), tuple(r.premises)) for r in dv.shortened(df, keep_used=False).collect()}
    assert (("n3",), ("n1", "s5")) in all_in and not [h for h, _ in all_in if "k" in h]


@pytest.mark.parametrize("most", [0, 6, 1 << 20])
def test_what_goals_rest_on_does_not_depend_on_where_it_is_searched(spark, monkeypatch, most):
    monkeypatch.setattr(dv, "MOST_ENTRIES", most)
    rng = random.Random(5)
    steps = [(p, f"f{i}", [f"f{rng.randrange(9)}" for _ in range(rng.randrange(3))] + [None] * (i == 3)) for p in (1, 2, 3, None) for i in range(p or 1, 8)]
    facts = [(p, f"f{i}", [rng.randrange(6) for _ in range(rng.randrange(3))] or None) for p in (1, 2, 3, None) for i in range(9)]
    points = [(p, q, [rng.randrange(6)]) for p in (1, 2, 3) for q in range(6)]
    tables = [spark.createDataFrame(r, f"problem long, {c}") for r, c in ((steps, "head string, premises array<string>"), (facts, "fact string, args array<int>"), (points, "point int, rely_on array<int>"), ([(p, "f7") for p in (1, 2, 3, None, 4)], "fact string"))]
    got = dv.dependency_difference(*tables)
    want = {tuple(r) for r in dv._difference_in_rounds(*tables, 1000).collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5
    assert got.count() == len(want)


def test_a_problem_is_searched_without_rounds_of_joins(spark):
    n = 200  # so many rounds would take minutes
    steps = spark.createDataFrame([(1, k, [k - 1]) for k in range(1, n)], "problem long, head long, premises array<long>")
    none = spark.createDataFrame([], "problem long, fact long, args array<long>")
    points = spark.createDataFrame([], "problem long, point long, rely_on array<long>")
    got = dv.dependency_difference(steps, none, points, spark.createDataFrame([(1, n - 1)], "problem long, fact long"), most_rounds=3)
    assert sorted((int(r.fact), r.part) for r in got.collect()) == [(k, "setup" if k == 0 else "goal" if k == n - 1 else "proof") for k in range(n)]
