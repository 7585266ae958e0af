"""Statements with known outcomes, proofs and filters."""

import math

import pytest

from axiomill.functions.realise import base_facts, holds_at, meets, realise
from axiomill.operators.algebra import Classes
from axiomill.plans import prove, rules, strict
from axiomill.queries import FEW, FILTERED, STATEMENTS
from axiomill.sources.statements import clause, definitions, point_name, renamed, rules as parse_rules, statement

DEFS = prove.own_definitions()


def few():
    return [r for r in rules.standard_rules() if r.name in FEW]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "problem_id string, statement string")


def test_parsing():
    text = "a b c = triangle a b c; h = on_tline h b a c, on_tline h c a b ? perp a h b c"
    s = statement(text)
    assert s.text() == text and renamed(s).text() == text.replace("h", "d")
    assert clause("a@1.5_2 = free a").at == {"a": (1.5, 2.0)} and [point_name(i) for i in (0, 25, 26, 27)] == ["a", "z", "a1", "b1"]
    assert len(DEFS) == prove.DEFINITIONS.strip().count("\n\n") - 1 or len(DEFS) >= 13
    assert DEFS["incenter"].basics[0][0] == ["x"] and len(DEFS["incenter"].basics[0][1]) == 2
    assert definitions("")== {}
    with pytest.raises(ValueError):
        parse_rules("perp a b c d => para a b c d, coll a b c")
    assert len(rules.standard_rules()) == 43 and all(rules._atoms(r) for r in rules.standard_rules())


@pytest.mark.parametrize("name, text", STATEMENTS)
def test_diagrams_satisfy_their_facts(name, text):
    s = statement(text)
    xy = realise(s, DEFS)
    assert all(holds_at(n, a, xy) for n, a, _ in base_facts(s, DEFS)) and holds_at(s.goal[0], list(s.goal[1]), xy)
    assert realise(s, DEFS) == xy  # the same diagram each time
    k = Classes([(n, a) for n, a, _ in base_facts(s, DEFS)], xy)
    assert all(k.holds(n, a) for n, a, _ in base_facts(s, DEFS))


def test_outcomes_and_proof(spark):
    st = frame(spark, [*STATEMENTS, ("unreadable", "a = nosuch b ? perp a b c d")])
    got = {r.problem_id: r.status for r in prove.prove(spark, st, rules=few(), most_levels=4).collect()}
    assert got == {"altitudes": "unsolved", "altitudes_with_foot": "solved", "bisectors": "solved", "midline": "solved", "unreadable": "error"}


def test_rules_alone_do_not_reach_what_algebra_does(spark):
    got = prove.prove(spark, frame(spark, [STATEMENTS[2]]), rules=few(), algebra=False, most_levels=4).first()
    assert got.status == "unsolved"


def test_proof_has_setup_and_auxiliary_facts(spark):
    st = frame(spark, [STATEMENTS[1]])
    facts, points = prove.build(spark, st, DEFS)
    facts, points = prove.staged(facts, "f"), prove.staged(points, "p")
    closed, _ = prove.deduce(facts, points, few(), most_levels=4)
    steps = prove.staged(prove.proof_table(closed, points, st, DEFS), "steps")
    part = lambda p: {r.fact for r in steps.collect() if r.part == p}
    assert part("setup") == {"perp a c b d", "perp a b c d"} and part("auxiliary") == {"coll a c e", "coll b d e"}
    known: set = set()
    for r in sorted(steps.collect(), key=lambda r: r.step):  # nothing is used before it is shown
        assert set(r.premises) <= known
        known.add(r.fact)
    text = prove.proof_text(steps).first().proof
    assert text.splitlines()[-1].endswith("perp a d b c [algebra]")
    xy = {r.p: (r.xy.x, r.xy.y) for r in points.collect()}
    for r in closed.collect():  # derived facts are true in the diagram
        if "tri" in r.name:
            side = lambda i, j, a=r.args: math.dist(xy[a[i]], xy[a[j]]) / math.dist(xy[a[i + 3]], xy[a[j + 3]])
            assert abs(side(0, 1) - side(1, 2)) < 1e-6 and abs(side(0, 1) - side(0, 2)) < 1e-6
        else:
            assert holds_at(r.name, list(r.args), xy)


ROWS = "id string, visible string, target string"


def test_strict_filter(spark):
    got = {r.id: r for r in strict.strict_filter(spark, spark.createDataFrame(FILTERED, ROWS), rules=few(), most_levels=4, minimised="exact").collect()}
    assert {k: r.category for k, r in got.items()} == {
        "needs_foot": "aux_required", "needs_one_of_two": "aux_required", "needs_nothing": "visible_solved", "never": "restored_failed", "false_goal": "visible_error", "point_known": "auxiliary_error",
        "no_definition": "auxiliary_error", "no_goal": "parse_error", "no_target": "parse_error", "null_target": "parse_error",
    }
    one = got["needs_one_of_two"]
    assert (one.target, one.minimisation, one.clauses_before, one.clauses_after) == ("e = on_line e a c, on_line e b d", "exact", 2, 1)
    assert one.statement == STATEMENTS[0][1].replace(" ? ", "; e = on_line e a c, on_line e b d ? ") and got["never"].statement is None


def test_strict_filter_repeats_and_drops_single_clauses(spark):
    rows = [(i, STATEMENTS[0][1], t) for i, t in (("x", "f = midpoint f a b; e = on_line e a c, on_line e b d; g = midpoint g b c"), ("x", "e = midpoint e a b"), (None, "e = on_line e a c, on_line e b d"))]
    got = {(r.id, r.category): r for r in strict.strict_filter(spark, spark.createDataFrame([*rows, rows[0]], ROWS), rules=few(), most_levels=4, repeats=2, minimised="greedy").collect()}
    assert set(got) == {("x", "aux_required"), ("x", "restored_failed"), (None, "aux_required")}
    best = got["x", "aux_required"]
    assert (best.target, best.minimisation, best.clauses_before, best.clauses_after) == ("e = on_line e a c, on_line e b d", "greedy", 3, 1)
    assert got[None, "aux_required"].minimisation == "none"


def test_strict_filter_of_nothing(spark):
    assert strict.strict_filter(spark, spark.createDataFrame([], ROWS), rules=few(), most_levels=1).collect() == []
    with pytest.raises(ValueError):
        strict.strict_filter(spark, spark.createDataFrame([], ROWS), minimised="most")


def test_requirements_and_points():
    xy = {"a": (0.0, 0.0), "b": (1.0, 0.0), "c": (2.0, 0.0), "d": (0.0, 1.0), "e": (1.0, 1.0)}
    told = [("ncoll", "a b d", True), ("ncoll", "a b c", False), ("npara", "a d a b", True), ("npara", "a b d e", False), ("nperp", "a b a e", True), ("nperp", "a b a d", False), ("diff", "a b", True), ("diff", "a a", False), ("para", "a b d e", True), ("cong", "a b a c", False), ("ncoll", "a b z", False)]
    assert all(meets(n, a.split(" "), xy) == want for n, a, want in told)
    flat = statement("a b = segment a b; c = on_line c a b; d = foot d a b c")
    assert realise(flat, DEFS, tries=3) is None and realise(statement("a b c = triangle a b c; d = foot d a b c"), DEFS)
    with pytest.raises(ValueError):
        realise(statement("a b c = triangle a b c; a = midpoint a b c"), DEFS)


def test_minimise():
    need = {"b", "d"}
    assert prove.minimise(lambda c: need <= set(c), list("abcd")) == ["b", "d"]
    assert prove.minimise(lambda c: need <= set(c), list("abcdefg")) == ["b", "d"]


def test_beam_search(spark):
    offered = []

    def propose(text):
        offered.append(text)
        return [("e = midpoint e a b", -0.1), ("e = on_line e a c, on_line e b d", -0.5)]

    got = prove.beam_search(spark, STATEMENTS[0][1], propose, beam=2, depth=1, rules=few(), most_levels=4)
    assert got["solved"] and got["depth"] == 1 and got["tried"] == 2 and "on_line e b d" in got["statement"] and offered == [STATEMENTS[0][1]]


def test_a_middle_point_leaves_the_plan_before_the_next_join_and_why_tells_the_first(spark):
    rule = next(r for r in rules.standard_rules() if r.name == "r00")
    at = lambda i: (float(i * 37 % 101), float(i * 61 % 97))
    segments = {("p1", "p2", 0), ("p3", "p4", 0), ("p5", "p10", 0), ("p6", "p7", 5), ("p60", "p7", 5), ("p8", "p9", 5)}
    both = sorted(segments | {(b, a, d) for a, b, d in segments})
    pair = spark.createDataFrame([("t", a, b, d, at(int(a[1:])), at(int(b[1:]))) for a, b, d in both], "problem_id string, a string, b string, dir int, pa struct<x:double,y:double>, pb struct<x:double,y:double>")
    perp = spark.createDataFrame([("t", 0, 5), ("t", 5, 0)], "problem_id string, d1 int, d2 int")
    got = rules.match(rule, {"pair": pair, "perp": perp})
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda word: [i for i, line in enumerate(plan) if word in line]
    assert len(depth("Aggregate")) > 1 and min(depth("Join")) < depth("Aggregate")[1]
    area = lambda a, b, e: (lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))(*(at(int(x[1:])) for x in (a, b, e)))
    want = {}
    for a, b, d in both:
        for c, dd, turned in both:
            for e, f, last in both:
                if turned == (d + 5) % 10 and last == d and area(a, b, e) != 0:
                    key = "para " + " ".join(x for two in sorted([sorted([a, b]), sorted([e, f])]) for x in two)
                    why = [f"perp {a} {b} {c} {dd}", f"perp {c} {dd} {e} {f}"]
                    want[key] = min(want.get(key, why), why)
    assert {r.key: r.why for r in got.collect()} == want and want
    assert all(r.key == "para " + " ".join(r.args) for r in got.collect())


def test_segments_are_dealt_once_and_matched_where_they_are(spark):
    import duckdb

    from axiomill import queries

    rule = next(r for r in rules.standard_rules() if r.name == "r00")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        with rules.problems_together(spark):
            plan = rules.match(rule, queries._segment_tables(spark, "/root/testdata/sf0.001")).select("problem_id", "key")._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in queries.rule_match_guarded(spark, "/root/testdata/sf0.001").collect()]
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == held["spark.sql.requireAllClusterKeysForCoPartition"]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    dealt = [line for line in plan.splitlines() if "Exchange" in line and "ReusedExchange" not in line]
    assert len(dealt) == 1 and "hashpartitioning(problem_id" in dealt[0] and plan.count("SortMergeJoin") == 5
    with duckdb.connect() as c:
        c.execute("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
        want = c.execute(queries.SQL["rule_match_guarded"]).fetchall()
    assert sorted(got) == sorted(want) and want
