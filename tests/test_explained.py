"""Exact elimination over tables of problems."""

from axiomill.operators.algebra import explained


def test_problems_of_any_key_are_answered_without_a_call_for_each(spark):
    equations = spark.createDataFrame([(k, f"f{i}", f"x{i} - x{i + 1}") for k in (1, 2, None) for i in (2, 1)] + [(3, "f1", "x1 - x2"), (4, "f1", "x1 - x2")], "problem_id long, fact string, equation string")
    goals = spark.createDataFrame([(k, g) for k in (1, 2, None) for g in ("x1 - x3", "x2 - x3")] + [(3, "x1 - x3"), (5, "x1 - x2")], "problem_id long, goal string")
    df = explained(equations, goals)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = [(k, g, True, w) for k in (1, 2, None) for g, w in (("x1 - x3", ["f1", "f2"]), ("x2 - x3", ["f2"]))] + [(3, "x1 - x3", False, []), (5, "x1 - x2", False, [])]
    assert got == sorted(want, key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
