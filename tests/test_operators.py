"""Corpus operators against known literals and row-by-row versions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from axiomill.operators import algebra, components, corpus, select, stats


def test_first_row_wins(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcdef"), rng.choice([None, "x"])) for i in range(200)]
    got = {tuple(r) for r in corpus.first_wins(spark.createDataFrame(rows, "i int, k string, v string").repartition(5), F.col("k"), ["i"]).collect()}
    want = {}
    for r in rows:
        want.setdefault(r[1], r)
    assert got == set(want.values())


def test_merge_modes_and_counters(spark):
    rows = [(1, "a b = segment a b", "c = midpoint c a b", 0.5), (2, "x y = segment x y", "z = midpoint z x y", None), (3, "a b = segment a b", "c = midpoint c a b", 0.9), (4, "p q = segment p q", "r = foot r p q", 0.1)]
    df = spark.createDataFrame(rows, "ord int, visible string, target string, fraction double")
    ids = lambda mode, least=0.0: [r.ord for r in corpus.merge(df, mode, ["ord"], "visible", "target", "fraction", least).orderBy("ord").collect()]
    assert ids("none") == [1, 2, 3, 4] and ids("exact") == [1, 2, 4] and ids("canonical") == [1, 4] and ids("canonical", 0.6) == [2]
    kept = corpus.keep_at_least(df, "fraction", 0.2)
    assert tuple(corpus.merge_counters(df, kept, corpus.merge(kept, "canonical", ["ord"], "visible", "target")).first()) == (4, 0, 1, 2, 1)
    with pytest.raises(ValueError):
        corpus.dedupe_key("other", "a", "b")


def test_splits(spark):
    df = spark.createDataFrame([(i, None if i % 50 == 0 else f"k{i % 40}") for i in range(400)], "i int, k string")
    got = corpus.assign_split(df, "k", 3, 0.2, 0.2).groupBy("k").agg(F.countDistinct("split").alias("n")).collect()
    assert all(r.n == 1 for r in got)
    with pytest.raises(ValueError):
        corpus.split_of(F.lit(0.5), 0.6, 0.4)


@pytest.mark.parametrize("total, wanted", [(100, 13), (5, 5), (7, 0), (1000, 1)])
def test_systematic_sample(spark, total, wanted):
    at = corpus.systematic_indices(total, wanted, 7)
    assert len(set(at)) == wanted and at == sorted(at) and at == corpus.systematic_indices(total, wanted, 7) and all(0 <= i < total for i in at)
    ids = [i * i * 3 - 50 for i in range(total)]
    df = spark.createDataFrame([(i, "x") for i in ids], "id long, v string").repartition(3)
    got = sorted((r.position, r.id) for r in corpus.systematic_sample(df, "id", wanted, 7).collect())
    assert got == [(i, ids[i]) for i in at]


def test_too_large_a_sample():
    with pytest.raises(ValueError):
        corpus.systematic_indices(3, 4, 1)


@pytest.mark.parametrize("outcomes, visible, restored", [(["solved", "error"], "solved", "error"), (["unsolved"], "unsolved", "unsolved"), (["unsolved", "ddar_timeout"], "timeout", "timeout"), (["level_limit", "error"], "timeout", "timeout"), (["error", "unsolved"], "error", "error"), (["solved"], "solved", "solved"), (["solved", "unsolved"], "solved", "unsolved")])
def test_votes(spark, outcomes, visible, restored):
    o = F.array(*map(F.lit, outcomes))
    assert tuple(spark.range(1).select(corpus.combine_votes(o, True), corpus.combine_votes(o, False)).first()) == (visible, restored)


def test_masked_examples(spark):
    df = spark.createDataFrame([([1, 2, 3], [8, 9])], "p array<int>, t array<int>")
    for limit, ids, labels in ((9, [1, 2, 3, 8, 9], [-100] * 3 + [8, 9]), (4, [2, 3, 8, 9], [-100] * 2 + [8, 9]), (2, None, None)):
        i, lab = corpus.masked_example(F.col("p"), F.col("t"), limit)
        assert tuple(df.select(i, lab).first()) == (ids, labels)
    assert df.select(corpus.padded(F.col("p"), corpus.pad_width(F.size("p")), 0)).first()[0] == [1, 2, 3, 0, 0, 0, 0, 0]


def cell_rows(spec):
    return [(f"{f}{g}{i}", f, g) for f, g, n in spec for i in range(n)]


def counts(spec, wanted, **caps):
    got = select.chosen_counts({(f, g): n for f, g, n in spec}, wanted, **caps)
    families = {}
    for (f, _), n in got.items():
        families[f] = families.get(f, 0) + n
    return got, families


def test_balanced_counts():
    assert counts([("reflect", "p", 10), ("midpoint", "p", 2), ("foot", "p", 2)], 6)[1] == {"reflect": 2, "midpoint": 2, "foot": 2}
    assert counts([("x", "perp", 4), ("x", "para", 4)], 4)[0] == {("x", "perp"): 2, ("x", "para"): 2}
    assert sum(counts([("x", "p", 10)], 0, family_cap=3)[1].values()) == 3
    got = counts([("a", "p", 20), ("b", "p", 10), ("c", "p", 10)], 0, family_fraction=0.4)[1]
    assert sum(got.values()) < 40 and max(got.values()) <= -(-0.4 * sum(got.values()) // 1)
    with pytest.raises(ValueError):
        select.chosen_counts({("a", "b"): 1}, 1, goal_fraction=2)


def test_balanced_rows_in_closed_form_are_those_of_the_rounds(spark):
    rng = random.Random(3)
    for _ in range(4):
        spec = [(f, g, rng.randrange(0, 7)) for f in "abc" for g in "xyz"]
        df = spark.createDataFrame(cell_rows(spec), "id string, family string, goal string")
        cap = rng.choice([0, 4])
        got = select.balanced(df, "family", "goal", [F.col("id")], 14, family_cap=cap).collect()
        want = select.chosen_counts({(f, g): n for f, g, n in spec if n}, 14, family_cap=cap)
        seen = {}
        for r in got:
            seen[r.family, r.goal] = seen.get((r.family, r.goal), 0) + 1
        assert seen == want and sorted(r.place for r in got) == list(range(len(got)))
        under = select.balanced_under_caps(df, "family", "goal", [F.col("id")], 14, family_cap=cap, goal_cap=5).collect()
        assert all(sum(r.goal == g for r in under) <= 5 for g in "xyz")


def test_beam_queue_replaces_only_for_better():
    q = select.BeamQueue(2)
    for s, e in ((1, "a"), (3, "b"), (1, "c"), (2, "d")):
        q.add(s, e)
    assert list(q) == [(2, "d"), (3, "b")]


def test_metrics(spark):
    df = spark.createDataFrame([("g", x) for x in "aaabbcde"], "g string, n string")
    r = stats.distribution_metrics(df, ["g"], "n").first()
    assert (r.coverage, r.effective_names, r.top_four_fraction) == (5, 4.456, 0.875)
    rng = random.Random(4)
    for n in (1, 2, 7, 100):
        v = [rng.randrange(30) for _ in range(n)]
        got = stats.length_summary(spark.createDataFrame([("g", x) for x in v], "g string, v int"), ["g"], "v", 20).first()
        at = lambda f, v=v: sorted(v)[round((len(v) - 1) * f)]
        assert (got.rows, got.min, got.p50, got.p90, got.p95, got.p99, got.max, got.over_limit) == (n, min(v), at(0.5), at(0.9), at(0.95), at(0.99), max(v), sum(x > 20 for x in v))


def test_exact_match(spark):
    df = spark.createDataFrame([("a", ["a", "b"], [True, False]), ("b", ["a", "b"], [False, True]), ("c", [], [])], "t string, p array<string>, v array<boolean>")
    r = stats.exact_match(df, F.col("t"), F.col("p"), F.col("v")).first()
    assert (r.rows, r.top1_exact, r.topk_exact, r.top1_valid, r.topk_any_valid, r.topk_exact_and_valid) == (3, 0.333333, 0.666667, 0.333333, 0.666667, 0.666667)


def test_closures(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(50)}
    reach = set(edges)
    while new := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= new
    df = spark.createDataFrame(sorted(edges), "a int, b int")
    assert {tuple(r) for r in components.transitive_closure(df).collect()} == reach
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {tuple(r) for r in components.connected_components(df).collect()} == {(x, r) for x, r in label.items() if x != r}


# ---- exact algebra -------------------------------------------------------------------------------------------------------


def test_merged_groups():
    got, links = algebra.merged_groups([{1, 2}, {3, 4, 5}, {6, 7}], [{2, 3, 8}, {9, 10, 11}])
    assert got == [{1, 2, 3, 4, 5, 8}, {6, 7}, {9, 10, 11}] and links == [(2, 3), (3, 8), (9, 10), (10, 11)]
    got, links = algebra.merged_groups([{1, 2}, {3, 4}, {5, 6}, {7, 8}], [{2, 3, 8, 9, 10}, {3, 6, 11}])
    assert got == [set(range(1, 12))] and links == [(2, 3), (3, 8), (8, 9), (9, 10), (3, 6), (6, 11)]
    got, links = algebra.merged_groups([], [{1, 2}, {3, 4}, {5, 6}, {2, 3}])
    assert got == [{1, 2, 3, 4}, {5, 6}] and links == [(1, 2), (3, 4), (5, 6), (2, 3)]


# The groups, links and explanations that the published system gives for these inputs.


def test_explanations_are_small():
    system = [("f1", algebra.linear("a - b - b + c")), ("f2", algebra.linear("d - a - c + d")), ("f3", algebra.linear("x - y - z + t"))]
    assert algebra.explain(system, algebra.linear("b - d")) == ["f1", "f2"]
    assert algebra.explain(system, algebra.linear("x - d")) is None


def test_shortest_explanation_of_equality():
    merges = [("f1", "la - lb"), ("f2", "lb - lc"), ("f3", "la - lc"), ("f4", "lc - ld")]
    assert algebra.explain([(n, algebra.linear(t)) for n, t in merges], algebra.linear("la - ld")) == ["f3", "f4"]


def test_elimination_is_exact():
    rng = random.Random(6)
    names = "pqrstu"
    for _ in range(50):
        truth = {x: Fraction(rng.randrange(-9, 9), rng.randrange(1, 7)) for x in names}
        system = algebra.System(("one",))
        for _ in range(5):
            term = {x: Fraction(rng.randrange(-3, 4)) for x in rng.sample(names, 3)}
            system.add(algebra.plus({k: v for k, v in term.items() if v}, {"one": sum(v * truth[k] for k, v in term.items())}, -1))
        for x in names:
            form, _ = system.reduce({x: Fraction(1)})
            free = {k for k in form if k not in ("one",)}
            assert free or form.get("one", 0) == truth[x]


def test_audited_sample(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "i long, t string")
    sample, audit = corpus.audited_sample(df, "i", "t", 10, 7)
    told = {r.side: (r.rows, r.digest) for r in audit.collect()}
    assert told["source"][0] == 50 and told["sample"][0] == 10 and told["source"] == tuple(corpus.content_digest(df.repartition(3), "t").first())
    assert told["sample"] == tuple(corpus.content_digest(sample, "t").first())


def one_row_at_a_time(cells, size, family_limit, goal_limit):
    """Families in turn, each from its next goal that can give; written row by row to compare with."""
    families = sorted({f for f, _ in cells})
    goals = {f: sorted(g for x, g in cells if x == f) for f in families}
    got, at = dict.fromkeys(cells, 0), dict.fromkeys(families, 0)
    moved = True
    while moved:
        moved = False
        for f in families:
            for step in range(len(goals[f])):
                g = goals[f][(at[f] + step) % len(goals[f])]
                full = sum(n for (x, _), n in got.items() if x == f) >= family_limit or sum(n for (_, y), n in got.items() if y == g) >= goal_limit
                if sum(got.values()) < size and not full and got[f, g] < cells[f, g]:
                    got[f, g] += 1
                    at[f] += step + 1
                    moved = True
                    break
    return got


def test_many_rounds_at_once_are_the_rounds_one_by_one():
    rng = random.Random(6)
    for _ in range(300):
        cells = {(f, g): rng.choice([0, 1, 2, 9, 30]) for f in "abcd"[: rng.randrange(1, 5)] for g in "wxyz" if rng.random() < 0.8} or {("a", "w"): 3}
        size, fam, goal = rng.randrange(1, 120), rng.choice([float("inf"), 5, 21]), rng.choice([float("inf"), 4, 25])
        assert select._rounds(cells, size, fam, goal) == one_row_at_a_time(cells, size, fam, goal)
    assert sum(select.chosen_counts({("a", "x"): 10**9, ("b", "x"): 10**9, ("b", "y"): 7}, 0).values()) == 2 * 10**9 + 7
