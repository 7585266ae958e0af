"""Conversion of rows into training pairs, and the folder between rounds."""

import threading

import pytest

from axiomill.plans import convert, prove, staging

DEFS = prove.own_definitions()
VISIBLE = "a b c = triangle a b c ? perp a b b c"


def converted(spark, rows, **how):
    return convert.convert_rows(spark.createDataFrame(rows, "id string, visible string, target string"), DEFS, **how)


def test_whole_targets(spark):
    rows = [("one", VISIBLE, "d = midpoint d a b"), ("two", VISIBLE, "d = midpoint d a b; e = midpoint e b c"), ("none", None, "d = midpoint d a b"), ("empty", VISIBLE, None)]
    got = {r.row_id: r for r in converted(spark, rows).collect()}
    assert (got["one"].outcome, got["one"].families, got["one"].text) == ("written", ["midpoint"], f"{got['one'].prompt} {got['one'].target}")
    assert got["one"].prompt == "{S} a : ; b : ; c : ? T a b b c {F1} x00" and got["one"].target.startswith("d : ")
    assert (got["two"].outcome, got["two"].reason) == ("rejected", "multi_target") and got["none"].outcome == got["empty"].outcome == "error"
    assert converted(spark, rows[1:2], many_groups=True, most_predicates=-1).first().outcome == "written"
    assert converted(spark, rows[:1], most_predicates=1).first().reason == "too_many_predicates"
    assert converted(spark, []).collect() == []


def test_actions_and_counts(spark):
    rows = [("good", VISIBLE, "d = midpoint d a b; e = on_line e d c"), ("late", VISIBLE, "d = on_line d a b; e = midpoint e b c; f = on_line f a c"), ("bad", VISIBLE, "d = nowhere d a")]
    made = converted(spark, rows, split_actions=True, most_predicates=1)
    late = sorted((r.action_index, r.outcome, r.reason) for r in made.collect() if r.row_id == "late")
    assert late == [(0, "discarded", "incomplete_action_sequence"), (1, "rejected", "too_many_predicates"), (2, "unreachable", None)]
    wide = converted(spark, rows, split_actions=True)
    assert convert.conversion_counts(wide).first().asDict() == {"read": 3, "written": 5, "actions_seen": 5, "actions_rejected": 0, "actions_discarded_with_row": 0, "unreachable_actions": 0, "rows_complete": 2, "rows_partial": 0, "rows_rejected": 0, "errors": 1}
    counts = convert.conversion_counts(made).first()
    assert (counts.written, counts.rows_partial, counts.rows_rejected, counts.unreachable_actions, counts.errors) == (0, 1, 2, 2, 1)
    by = {r.family: (r.seen, r.written, r.rejected, r.reasons) for r in convert.conversion_by_family(made).collect()}
    assert by["on_line"][1] == 0 and "incomplete_action_sequence: 1" in by["on_line"][3]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())


def test_threads_leave_the_setting_as_it_was(spark):
    before = spark.conf.get(staging._CLEANUP, "false")
    threads = [threading.Thread(target=lambda: staging.staged(spark.range(10), "t")) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(staging._CLEANUP, "false") == before and not staging._writers
