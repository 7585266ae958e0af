import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from axiomill.llm import mixing as m

from .helpers import docs, none, odd


def test_targets():
    got = m.capped_shares({"hot": 700, **{str(i): 10 for i in range(30)}}, 0.25)
    assert got["hot"] == 0.25 and abs(sum(got.values()) - 1) < 1e-9 and len(set(got.values())) == 2
    assert m.capped_shares({"a": 3, "b": 1}, 0.25) == {"a": 0.75, "b": 0.25}
    assert m.capped_shares({}, 0.25) == {}


@pytest.mark.parametrize("weights", [None, {"hot": 1, "b": 2, "c": 3, "d": 1, "e": 1}])
def test_mix(spark, weights):
    rng = random.Random(2)
    sources = ["hot"] * 3000 + [rng.choice("bcde") for _ in range(2500)]
    if weights is None:
        sources = [s if s == "hot" else s + str(i % 4) for i, s in enumerate(sources)]
    texts = [f"text {i}" for i in range(len(sources))]
    got = m.mix_sources(docs(spark, texts, sources=sources), weights, block_rows=4).collect()
    assert sorted(r.position for r in got) == list(range(len(texts)))
    assert [r.slot for r in sorted(got, key=lambda r: r.position)] == sorted(r.slot for r in got)
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert len({(r.source, r.block): r.slot for r in got}) == len({r.slot for r in got})
    size = Counter(r.source for r in got)
    kept = Counter(r.source for r in got if r.in_mix)
    full = weights or m.capped_shares(size, 0.25)
    ran = {s: max(r.slot for r in got if r.source == s) for s in size}
    least = min(ran.values())
    total = sum(full.values())
    for s in size:  # while all sources last
        assert abs(sum(1 for x in {r.slot for r in got if r.source == s} if x < least) - least * full[s] / total) < 1 + least / 200
    if weights is None:
        assert all(kept[s] == size[s] for s in size if s != "hot") and 0 < kept["hot"] < size["hot"]


def test_stage_keeps_columns_and_order(spark):
    df = docs(spark, [f"t{i}" for i in range(400)], sources=["x" if i % 3 else "y" for i in range(400)])
    got = [r.doc_id for r in m.mixed(df).collect()]
    place = {r.doc_id: r.position for r in m.mix_sources(df).where("in_mix").collect()}
    assert got == sorted(place, key=place.get)


def test_odd_tables(spark):
    got = m.mix_sources(odd(spark)).collect()
    assert len(got) == 12 and len({r.position for r in got}) == 11  # a row repeated in full shares its place
    assert m.mix_sources(none(spark)).collect() == []
    assert m.mixed(odd(spark)).columns == odd(spark).columns and m.mixed(odd(spark)).count() == 12


def test_less_than_one_block_from_the_weight_however_long():
    counts = {"hot": 64_000, **{f"s{i:02}": 6_337 + i for i in range(20)}}
    names = sorted(counts)
    target = m.capped_shares(counts, 0.25)
    parts, blocks = m.whole_parts([target[k] for k in names]), [counts[k] for k in names]
    total, had = sum(parts), [0] * len(names)
    plan = list(m.schedule(parts, blocks))
    assert len({x[0] for x in plan}) == len(plan) == sum(blocks)
    full = min(b * total // p for b, p in zip(blocks, parts, strict=True)) - 1  # all sources last until here
    for at, (slot, s, i, release, due) in enumerate(plan):
        assert release <= slot < due and i == had[s]
        had[s] += 1
        if slot < full and slot % 97 == 0:
            assert all(abs(h * total - (slot + 1) * p) < total for h, p in zip(had, parts, strict=True))
        if at == 50_000:  # a schedule taken up again goes on alike
            assert [x for x, _ in zip(m.schedule(parts, blocks, slot + 1, list(had)), range(500), strict=False)] == plan[at + 1 : at + 501]


def test_a_weight_below_a_period_is_kept(spark):
    sources = ["a"] * 3000 + ["b"] * 3
    got = m.mix_sources(docs(spark, [f"t{i}" for i in range(3003)], sources=sources), {"a": 1000, "b": 1}, block_rows=1).collect()
    assert max(r.deadline for r in got if r.source == "b") == 3003 and min(r.release for r in got if r.source == "b" and r.block == 1) == 1001


def test_the_stage_keeps_a_hot_source_and_slots_follow_the_mix(spark):
    import corpus_pipeline

    sources = [f"s{i % 20}" if i % 3 else "hot" for i in range(1800)]
    df = docs(spark, [f"text {i}" for i in range(1800)], sources=sources)
    plan = m.mix_sources(df, block_rows=16).collect()
    assert any(not r.in_mix for r in plan)
    place = {r.doc_id: r.position for r in plan}
    assert [r.doc_id for r in m.mixed(df).collect()] == sorted(place, key=place.get)
    shards = {}
    for r in corpus_pipeline.sharding(spark, df, "").collect():
        shards.setdefault(r.shard, []).append((r.slot, place[r.doc_id]))
    assert sum(map(len, shards.values())) == 1800
    for s in shards.values():
        assert [slot for slot, _ in sorted(s)] == list(range(len(s)))
        assert [at for _, at in sorted(s)] == sorted(at for _, at in s)


def test_blocks_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(m, "MAX_BLOCKS", 50)
    got = m.mix_sources(docs(spark, [f"t{i}" for i in range(2000)], sources=["a" if i % 3 else "b" for i in range(2000)])).collect()
    assert max(Counter((r.source, r.block) for r in got).values()) == 40 and len({r.slot for r in got}) <= 52
    assert sorted(r.position for r in got) == list(range(2000)) and all(r.release <= r.slot < r.deadline for r in got)


def test_names_of_extra_columns_never_clash(spark):
    names = ["__m_id", "__m_source", "__m_digest", "__m_position", "position", "row", "unit", "of", "__digest", "slot", "__u_doc_id"]
    df = docs(spark, ["a b", "c d", None], sources=["s", "t", "s"])
    for n in names:
        df = df.withColumn(n, F.lit(n))
    got = m.mixed(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_told_schedule_gives_natural_shares_where_a_source_has_more_than_a_quarter(spark, tmp_path):
    import duckdb

    from axiomill.llm import queries, sql

    rows = [(i, f"text {i}", "s0" if i % 10 < 4 else f"s{1 + i % 7}") for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        due = "-((-(b + 1) * total) // n[j])"  # DuckDB's // drops the fraction of a negative number, so this rounds down what is due rounded up
        assert due in sql.SQL["told_schedule"]
        want = c.execute(sql.SQL["told_schedule"].replace(due, "((b + 1) * total + n[j] - 1) // n[j]")).fetchall()
    got = [tuple(r) for r in queries.told_schedule(spark, str(tmp_path)).select("source", "block", "release", "deadline", "slot", "rows").collect()]
    assert sorted(got) == sorted(want)


def test_told_schedule_has_blocks_of_sixteen_rows_at_any_size(spark, tmp_path, monkeypatch):
    import duckdb

    from axiomill.llm import queries, sql

    monkeypatch.setattr(m, "MAX_BLOCKS", 5)
    monkeypatch.setattr(m, "CUT", 2)
    rows = [(i, f"text {i}", f"s{i % 4}") for i in range(800)]  # whole shares, whose deadlines need no rounding
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.execute(sql.SQL["told_schedule"]).fetchall()
    got = [tuple(r) for r in queries.told_schedule(spark, str(tmp_path)).select("source", "block", "release", "deadline", "slot", "rows").collect()]
    assert sorted(got) == sorted(want) and len(got) == 4 * 13
