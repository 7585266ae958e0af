from axiomill.plans import mine, prove
from axiomill.queries import FEW
from axiomill.plans.rules import standard_rules
from axiomill.sources.statements import statement

DEFS = prove.own_definitions()


def few():
    return [r for r in standard_rules() if r.name in FEW]


def test_samples_are_repeatable_and_can_be_read(spark):
    got = {r.problem_id: r.statement for r in mine.sample_statements(spark, 30, seed=5).collect()}
    assert got == {r.problem_id: r.statement for r in mine.sample_statements(spark, 30, seed=5).repartition(3).collect()} and len(got) > 20
    for text in got.values():
        known: set = set()
        for c in statement(text).clauses:
            assert all(set(a) <= known | set(c.points) for _, a in c.constructions)
            known |= set(c.points)


# Weights that must be those of the published tables.
def test_weights():
    assert [mine.weighted_pick(u, (("x", 70), ("y", 30))) for u in (0, 0.69, 0.71, 0.999)] == ["x", "x", "y", "y"]
    assert sum(w for _, w in mine.ROOTS) == 100


def test_mined_rows_need_their_addition(spark):
    text = "a b c = triangle a b c; d = on_tline d b a c, on_tline d c a b; e = on_line e a c, on_line e b d"
    st = spark.createDataFrame([("x", text)], "problem_id string, statement string")
    got = {r.goal: r for r in mine.mine(spark, st, DEFS, few(), most_levels=4, per_family=50).collect()}
    row = got["perp a d b c"]
    assert row.visible_problem == "a b c = triangle a b c; d = on_tline d b a c, on_tline d c a b ? perp a d b c" and row.target_auxiliary == "e = on_line e a c, on_line e b d"
    assert mine.orphan_count("perp a d b c", text, DEFS) == 1
    more = {r.goal for r in mine.counterfactuals(spark, st, DEFS, few(), most_levels=4).collect()}
    assert "perp a d b c" in more


def test_placements_are_prefixes_of_longer_ones():
    one = mine.placements("e = foot e a b c", list("abcd"), 3, 1)
    five, all_ = mine.placements("e = foot e a b c", list("abcd"), 3, 5), mine.placements("e = foot e a b c", list("abcd"), 3, 1000)
    assert one == ["e = foot e a b c"] and five == all_[:5] and len(all_) == len(set(all_)) == 24
    assert mine.placements("e = on_line e a b, on_line e c d", list("abcd"), 3, 9) == ["e = on_line e a b, on_line e c d"]


def test_bridges(spark):
    st = spark.createDataFrame([("free", "a b c = triangle a b c; d = on_tline d b a c"), ("foot", "a b c = triangle a b c; d = foot d a b c")], "problem_id string, statement string")
    facts, points = prove.build(spark, st, DEFS)
    old = spark.createDataFrame([(p, list("abc")) for p in ("free", "foot")], "problem_id string, ps array<string>")
    got = {r.problem_id: r.score for r in mine.bridge_scores(prove.staged(facts, "f"), prove.staged(points, "p"), old).collect()}
    assert got["foot"] > 0 and got["free"] > 0
    ranked = mine.ranked_proposals(spark.createDataFrame([("g", "x", 0, 3), ("g", "y", 1, 5), ("g", "a", 2, 3)], "group string, text string, index int, score long"), 2)
    assert [r.text for r in ranked.orderBy("place").collect()] == ["y", "a"]


def test_goals_of_all_choices(spark):
    """Every three of a line of four points and every four of a circle of five are goals, as are midpoints and equal angles."""
    st = spark.createDataFrame([("line", "a b = segment a b; c = on_line c a b; d = on_line d a b"), ("half", "a b c = triangle a b c; d = midpoint d a b; e = midpoint e a c")], "problem_id string, statement string")
    facts, points = prove.build(spark, st, DEFS)
    got = {}
    for r in mine.candidate_goals(prove.staged(facts, "f"), prove.staged(points, "p"), 10_000).collect():
        got.setdefault((r.problem_id, r.family), set()).add(r.goal)
    assert got[("line", "coll")] == {"coll a c d", "coll b c d"}
    assert got[("half", "midp")] == {"midp d a b", "midp e a c"} and ("half", "coll") not in got
    five = spark.createDataFrame([("o", "circle", "a b c d e", p) for p in "abcde"], "problem_id string, kind string, circle string, p string")
    chosen = {tuple(r.chosen) for r in mine._choices(five, "circle", 4).collect()}
    assert len(chosen) == 5 and all(list(c) == sorted(set(c)) for c in chosen)


def test_goals_without_facts(spark):
    facts, points = spark.createDataFrame([], prove.FACTS), spark.createDataFrame([], prove.POINTS)
    assert mine.candidate_goals(facts, points).collect() == []


def test_equal_values_are_all_pairs_of_one_value(spark):
    segments = {"ab": "1", "ac": "2", "bc": "3", "bd": "1"}
    values = {("1", "2"): "x", ("2", "1"): "y", ("2", "3"): "x", ("1", "3"): "x", ("1", "1"): "0"}
    pair = spark.createDataFrame([("o", *p, k) for p, k in segments.items()], "problem_id string, a string, b string, dir string")
    table = spark.createDataFrame([("o", *k, v) for k, v in values.items()], "problem_id string, k1 string, k2 string, v string")
    got = [tuple(r.args) for r in mine._equal_values(pair, "dir", table, "eqangle").collect()]
    sided = [((*p, *q), v, k) for k, v in values.items() if k[0] != k[1] for p in segments for q in segments if (segments[p], segments[q]) == k]
    want = {(*x, *y) for x, v, k in sided for y, w, m in sided if v == w and k != m and x < y}
    assert set(got) == want and len(got) == len(want) > 5
