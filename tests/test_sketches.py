"""Sketches against exact counts, functions of SQL, and sessions of streams against the same events in a batch."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axiomill.functions import hashing, registered
from axiomill.operators import sketches
from axiomill.streaming import ingest, sessions


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(4)
    rows = [(g, f"w{min(rng.randrange(1, 120), rng.randrange(1, 120), rng.randrange(1, 120))}") for g in ("a", "b", None) for _ in range(3000)]
    return rows, spark.createDataFrame(rows + [("a", None)], "g string, w string")


def test_count_min_is_never_below_and_seldom_far_above(spark, words):
    rows, df = words
    real = Counter(rows)
    got = sketches.at_most(df.dropna(), ["g", "w"], sketches.count_min(df.dropna(), ["g", "w"], width=256), width=256).collect()
    over = [r.most - real[(r.g, r.w)] for r in got]
    assert min(over) >= 0 and sum(o > math.e / 256 * len(rows) for o in over) <= 0.05 * len(over)


def test_sketches_merge(spark, words):
    _, df = words
    parts = df.randomSplit([1.0, 2.0], 3)
    whole = {(r.line, r.cell): r.n for r in sketches.count_min(df, ["w"], width=64).collect()}
    assert whole == {(r.line, r.cell): r.n for r in sketches.merged_counts(*[sketches.count_min(p, ["w"], width=64) for p in parts]).collect()}


@pytest.mark.parametrize("width", [8, 1 << 12])
def test_frequent_keys_are_exact_whatever_the_width(spark, words, width):
    rows, df = words
    got = {(r.g, r.w): r.n for r in sketches.frequent_keys(df, ["g", "w"], 40, width=width).collect()}
    assert got == {k: n for k, n in Counter(rows).items() if n >= 40} and got


def test_heavy_values_are_exact(spark, words):
    rows, df = words
    got = {(r.g, r.w): r.n for r in sketches.heavy_values(df, ["g"], "w", 0.01).collect()}
    assert got == {k: n for k, n in Counter(rows).items() if n >= 30} and got
    with pytest.raises(ValueError):
        sketches.heavy_values(df, ["g"], "w", 1e-6)


@pytest.mark.parametrize("most", [10, 100, 1 << 20])
def test_quantiles_are_exact_whatever_the_brackets(spark, most):
    rng = random.Random(most)
    rows = [(g, rng.choice([rng.gauss(0, 1), 0.5, 7.0])) for g in ("a", None) for _ in range(3000)] + [("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    q = [0.0, 0.013, 0.5, 0.97, 1.0]
    got = {(r.g, r.quantile): r.value for r in sketches.exact_quantiles(df, ["g"], "v", q, most=most).collect()}
    want = {}
    for g in ("a", None, "one", "same"):
        mine = sorted(v for h, v in rows if h == g and v is not None and v == v)
        want |= {(g, x): mine[max(1, math.ceil(x * len(mine))) - 1] for x in q}
    assert got == want


def test_functions_of_sql_are_those_of_the_library(spark):
    registered.register(spark)
    registered.register(spark)
    spark.createDataFrame([("k1", " A  b\tC "), ("é", None), (None, "")], "k string, t string").createOrReplaceTempView("am_rows")
    rows = spark.sql("SELECT k, t, am_fraction(k, '7') AS f, am_folded(t) AS folded, am_words(t) AS words, am_ratio(1, 3) AS third, am_ratio(1, 0) AS none, am_split(k, '7', 0.5D, 0.25D) AS split FROM am_rows")
    for r in rows.withColumn("own", hashing.stable_fraction(F.col("k"), 7)).collect():
        assert r.f == r.own and (r.third, r.none) == (0.3333, 0.0)
        assert r.folded == (" ".join(r.t.lower().split()) if r.t is not None else None) and r.words == (r.t.split() if r.t is not None else None)
        assert r.split == (None if r.f is None else "test" if r.f < 0.5 else "val" if r.f < 0.75 else "train") or r.f is None


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_islands_do_not_depend_on_batches(size):
    labels = ["a", "a", None, None, "b", "a", "a", "a", None, "b"]
    table = pa.table({"k": pa.array([5] * 10, pa.int64()), "at": pa.array(range(10), pa.int64()), "label": pa.array(labels)})
    udtf, out = registered.Islands(), []
    for batch in table.to_batches(max_chunksize=size):
        out += [r for t in udtf.eval(batch) for r in t.to_pylist()]
    out += [r for t in udtf.terminate() for r in t.to_pylist()]
    assert [(r["label"], r["first"], r["last"], r["n"]) for r in out] == [("a", 0, 1, 2), (None, 2, 3, 2), ("b", 4, 4, 1), ("a", 5, 7, 3), (None, 8, 8, 1), ("b", 9, 9, 1)]


SCHEMA = "user string, ts timestamp"


def events(spark, rng, n=240):
    rows = [(rng.choice(["u", "v", "w", None]), rng.choice([None, *[rng.randrange(0, 400_000)] * 30])) for _ in range(n)]
    return spark.createDataFrame(rows, "user string, s long").select("user", F.timestamp_seconds("s").alias("ts"))


@pytest.mark.parametrize("seed", range(2))
def test_a_stream_of_files_in_any_order_gives_the_sessions_of_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    df = events(spark, rng).cache()
    parts = df.randomSplit([1.0] * 4, seed)
    rng.shuffle(parts)
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = ingest.file_stream(spark, f"{tmp_path}/in/*", SCHEMA, files_per_batch=1)
    updates = ingest.drain(sessions.session_updates(stream, "user", "ts", 1_500_000, "10 days"), "sessions")
    got, want = (sorted(map(tuple, x.collect())) for x in (sessions.session_rows(updates), sessions.batch_sessions(df, "user", "ts", 1_500_000)))
    assert got == want and len(want) > 20 and updates.select("version").distinct().count() > 1


def test_sessions_close_behind_the_watermark_and_go_on_after_a_restart(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "user string, s long").select("user", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def drain():
        stream = ingest.file_stream(spark, f"{tmp_path}/in/*", SCHEMA, files_per_batch=1)
        return ingest.drain(sessions.session_updates(stream, "user", "ts", 60_000, "10 minutes"), "s", f"{tmp_path}/checkpoint", f"{tmp_path}/rows")

    put("1", [("u", 1000), ("u", 1030), ("v", 1010)])
    first = {tuple(r) for r in sessions.session_rows(drain()).collect()}
    assert first == {("u", 1_000_000, 1_030_000, 2), ("v", 1_010_000, 1_010_000, 1)}
    put("2", [("u", 1080), ("v", 90_000)])
    put("3", [("v", 90_010)])
    put("4", [("u", 1100), ("w", 90_000)])  # u's row is late by then
    rows = drain()
    assert {tuple(r) for r in sessions.session_rows(rows).collect()} == {("u", 1_000_000, 1_080_000, 3), ("v", 1_010_000, 1_010_000, 1), ("v", 90_000_000, 90_010_000, 2), ("w", 90_000_000, 90_000_000, 1)}
    assert {(r.key, r.start) for r in rows.where("closed").collect()} == {("u", 1_000_000), ("v", 1_010_000)}
