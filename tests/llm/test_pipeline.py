"""The pipeline against a brute-force version: each stage's decision is taken again by comparing everything with everything."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from axiomill.llm.quality import fit_quality, passage_features
from tests.conftest import SMALL

from .helpers import none, odd
from .test_decontamination import brute as contaminated
from .test_similar import shingles
from .test_simhash import groups


def test_run_against_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    model = fit_quality(docs, labels)
    keep = {}
    for d, r in rows.items():
        feats = np.concatenate([f for _, f in passage_features([r.text.encode()])])
        keep[d] = model.pool(*model.encode(feats), np.zeros(len(feats), int), 1)[0] >= 0.5
    rows = {d: r for d, r in rows.items() if keep[d]}
    sets = {d: shingles(r.text) for d, r in rows.items()}
    pairs = [(a, b) for a in rows for b in rows if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups(list(rows), pairs)
    rows = {d: r for d, r in rows.items() if root[d] == d}
    hit = contaminated({d: r.text for d, r in rows.items()}, [(r.item_id, r.text) for r in bench.collect()], 10)
    rows = {d: r for d, r in rows.items() if not hit[d][4]}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for d, r in rows.items()} and len(got) == len(rows)
    assert 0 < len(rows) < docs.count() and pairs
    per_shard = Counter(r.shard for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in per_shard.items())


def test_stages_take_odd_and_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none(spark), SMALL).collect() == [], name
        got = stage(spark, odd(spark), SMALL)
        assert name == "sharding" or got.columns == odd(spark).columns
        assert 0 < got.count() <= 12


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_slots_follow_the_order_that_the_mix_wrote(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(7)
    slots = {}
    for name, df in (("mixed", corpus_pipeline.mixing(spark, docs, SMALL)), ("as_read", docs.sort("doc_id"))):
        df.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        order = {r.doc_id: (r.f, r.i) for r in read.select("doc_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).collect()}
        got = corpus_pipeline.sharding(spark, read, SMALL).collect()
        slots[name] = {r.doc_id: (r.shard, r.slot) for r in got}
        for shard in {r.shard for r in got}:
            mine = sorted((r.slot, r.doc_id) for r in got if r.shard == shard)
            assert [x for x, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == sorted((d for _, d in mine), key=order.get)
    assert {d: s for d, (s, _) in slots["mixed"].items()} == {d: s for d, (s, _) in slots["as_read"].items()} and slots["mixed"] != slots["as_read"]
