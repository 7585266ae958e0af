"""Steps that tables of events and lines go through only where they must."""

from axiomill import queries
from axiomill.operators import merges, ratios, sketches
from tests.conftest import SMALL


def test_classes_of_few_levels_need_no_forest(spark, monkeypatch):
    monkeypatch.setattr(merges, "merge_forest", None)
    assert queries.merge_classes(spark, SMALL).count() > 0
    assert queries.merge_path_steps(spark, SMALL).columns == ["ask", "step", "a", "b", "level"]


def test_pairs_of_suppliers_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "PAIRED_ROWS", 500)
    seen = []
    monkeypatch.setattr(sketches, "frequent_keys", lambda pairs, *_: seen.append(pairs.rdd.getNumPartitions()))
    queries.frequent_supplier_pairs(spark, SMALL)
    assert seen[0] > 8


def test_a_unit_is_counted_in_one_grouping(spark):
    pairs = spark.createDataFrame([(1, "difference", "a:1", t) for t in (1, 1, 2)], "p int, kind string, unit string, times long")
    df = ratios.constant_ratios(pairs, ["p"])
    assert [tuple(r) for r in df.collect()] == [(1, "a:1", 2, 1, [1, 2])]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
