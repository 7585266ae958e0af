"""Flows against plain loops, with nulls, empty tables and rows that have no units."""

from pyspark.sql import functions as F

from axiomill.plans import flows
from axiomill.plans.staging import staged

ROWS = "id long, text string, units array<string>, family string, goal string, liked boolean"


def chosen(spark, rows, wanted=10, **how):
    df = spark.createDataFrame(rows, ROWS)
    return flows.select_units(df, "id", F.col("text"), "units", F.lower("units"), "family", "goal", F.array("units"), F.col("liked"), [F.col("id"), F.col("unit_at")], wanted, **how)


def test_rows_and_units_are_told_once_and_focus_comes_first(spark):
    rows = [(1, "t", ["A", "b"], "f", "g", False), (2, "t", ["zz"], "f", "g", True), (3, "u", ["a", "c"], "f", "g", True), (4, "v", ["d", "D"], "h", "g", None), (5, None, ["e"], "h", "k", False), (6, None, ["lost"], "h", "k", False), (7, "w", [], "f", "g", True), (8, "x", None, "f", "g", True)]
    got = chosen(spark, rows)
    assert got.counters.first().asDict() == {"rows_read": 8, "rows_unique": 6, "rows_duplicate": 2, "units": 7, "units_unique": 5, "units_duplicate": 2, "selected": 5, "focus_available": 1, "focus_selected": 1}
    assert [r.units for r in got.rows.orderBy("place").collect()] == ["c", "d", "A", "e", "b"]
    one = chosen(spark, rows, wanted=2)
    assert [r.units for r in one.rows.orderBy("place").collect()] == ["c", "d"] and one.rows.columns == [*[c for c in ROWS.replace(",", "").split()[::2] if c != "units"], "unit_at", "units", "place"]
    told = {(r.stage, r.field): r.coverage for r in one.metrics.collect()}
    assert told == {("before", "families"): 2, ("before", "goals"): 2, ("before", "types"): 5, ("after", "families"): 2, ("after", "goals"): 1, ("after", "types"): 2}


def test_a_long_row_is_not_copied_for_each_of_its_units(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(flows, "staged", lambda df, label: kept.append(set(df.columns)) or staged(df, label))
    df = spark.createDataFrame([(i, "x" * 5000, [f"u{i} {k}" for k in range(50)], "f", "g", False) for i in range(3)], ROWS)
    got = flows.select_units(df, "id", F.col("text"), "units", F.col("units"), "family", "goal", F.array("units"), F.col("liked"), [F.col("liked"), F.col("id"), F.col("unit_at")], 2, seen=["liked"])
    assert kept and not any({"text", "units"} & columns for columns in kept)
    assert [(r.id, len(r.text), r.units) for r in got.rows.orderBy("place").collect()] == [(0, 5000, "u0 0"), (0, 5000, "u0 1")]
    assert got.counters.first().units == 50


def test_a_family_gives_no_more_than_its_cap(spark):
    got = chosen(spark, [(i, str(i), [f"u{i}"], "f" if i < 8 else "h", "g", False) for i in range(10)], family_cap=3)
    assert got.counters.first().selected == 5


def test_nothing_to_select_from(spark):
    got = chosen(spark, [])
    assert got.rows.collect() == [] and set(got.counters.first().asDict().values()) == {0} and got.metrics.collect() == []


def test_a_sweep_with_missing_workers_and_no_output(spark):
    audits = spark.createDataFrame([("a", 0, 3600, 10, 40), ("a", 1, 1800, 10, 60), ("b", 1, 0, 0, 0)], "config string, worker int, seconds long, diagrams long, candidates long")
    filters = spark.createDataFrame([("a", 0, 900), ("a", 1, 900)], "config string, worker int, seconds long")
    rows = spark.createDataFrame([("a", 0, "d1", "t"), ("a", 0, "d1", "t"), ("a", 1, "d2", "s"), ("a", 1, None, "s")], "config string, worker int, diagram string, target string")
    got = {r.config: r for r in flows.sweep_report(audits, filters, rows, "config", 2).collect()}
    a, b = got["a"], got["b"]
    assert (a.complete, a.missing_generation, a.cpu_hours, a.generator_cpu_hours, a.strict_rows, a.unique_diagrams, a.unique_targets, a.max_rows_from_one_diagram) == (True, [], 2.0, 1.5, 4, 2, 2, 2)
    assert (a.max_diagram_fraction, a.keep_fraction, a.rows_per_1000_diagrams, a.rows_per_cpu_hour, a.diagrams_per_cpu_hour) == (0.5, 0.04, 200.0, 2.0, 1.0)
    assert (b.complete, b.missing_generation, b.missing_strict, b.cpu_hours, b.strict_rows, b.rows_per_cpu_hour) == (False, [0], [0, 1], 0.0, 0, 0.0)


def test_unknown_words_by_line(spark):
    lines = spark.createDataFrame([("p", 1, "a b x"), ("p", 2, "a"), ("p", 3, ""), ("q", 1, "x y"), (None, 9, None), ("p", 4, "y y")], "path string, line long, text string")
    known = spark.createDataFrame([("a",), ("b",), ("a",)], "word string")
    told = flows.unknown_lines(lines, ["path"], ["line"], F.split("text", " "), known)
    assert {tuple(r) for r in flows.unknown_report(told, ["path"]).collect()} == {("p", 3, 6, 3, 2, 0.5), ("q", 1, 2, 2, 1, 1.0)}
    assert {tuple(r) for r in flows.unknown_examples(told, ["path"], ["line"], 1).collect()} == {("p", 1, 1, 1), ("q", 1, 2, 1)}
