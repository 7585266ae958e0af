import zlib

import numpy as np
import pytest

from axiomill.llm import quality as q
from tests.conftest import MIDDLE, SMALL

from .helpers import docs, none, odd


def test_held_out_accuracy(spark):
    df, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = {r.doc_id: r for r in q.classify_quality(df, labels).collect()}
    assert len(got) == df.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) >= 0.95


def test_held_out_labels_play_no_part(spark):
    df, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = spark.createDataFrame([(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.quality, r.toxic) for r in labels.collect()], labels.schema)
    a, b = ({r.doc_id: round(r.score, 9) for r in q.classify_quality(df, x).collect()} for x in (labels, turned))
    assert a == b


def test_attention_gradient():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 7))
    x[:, -1] = 400
    bag, y = np.repeat(np.arange(6), 5), np.array([0, 1, 0, 1, 1, 0.0])
    model = q.AttentionMIL(x.mean(axis=0), x.std(axis=0) + 1)
    before = model.pool(*model.encode(x), bag, 6)
    model.fit(x, bag, y, steps=400)
    after = model.pool(*model.encode(x), bag, 6)
    assert np.abs(after - y).max() < 0.1 < np.abs(before - y).max()


def test_features_do_not_depend_on_neighbours_or_chunks(monkeypatch):
    texts = [b"", b"a", "é Über \n| x".encode() * 300, b"THE!! " * 500, b"word " * 2000]
    alone = [np.concatenate([f for _, f in q.passage_features([t])]) for t in texts]
    monkeypatch.setattr(q, "CHUNK", 1 << 30)
    index, feats = (np.concatenate(x) for x in zip(*q.passage_features(texts), strict=True))
    assert all(np.allclose(feats[index == i], alone[i]) for i in range(len(texts)))


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (7, None, 0), (5, 0, 0), (4, 1, None), (3, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    assert q.classify_quality(odd(spark), labels).count() == 12
    assert q.classify_quality(none(spark), labels).collect() == []
    assert {r.score for r in q.classify_quality(odd(spark), labels.limit(0)).collect()} == {0.5}
    kept = q.drop_low_quality(odd(spark), labels.limit(0))
    assert kept.count() == 12 and kept.columns == odd(spark).columns


@pytest.mark.parametrize("text", ["", "x", "a fine sentence of words."])
def test_scores_are_finite(spark, text):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert 0 <= q.classify_quality(docs(spark, [text, "y"]), labels).collect()[0].score <= 1


def test_the_stage_drops_what_the_operator_rejects(spark, monkeypatch):
    from pyspark.sql import functions as F

    from axiomill.llm import quality

    df = docs(spark, ["0.1", "0.3", "0.49", "0.5", "0.9"])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    monkeypatch.setattr(quality, "fit_quality", lambda *a, **k: None)
    monkeypatch.setattr(quality, "quality_scorer", lambda model: lambda text: text.cast("double"))
    taken = {r.doc_id for r in quality.classify_quality(df, labels).where(F.col("predicted") == 1).collect()}
    assert {r.doc_id for r in quality.drop_low_quality(df, labels).collect()} == taken == {3, 4}


def score(model, text):
    """The forward pass for one text, passage by passage in plain Python."""
    import math

    raw, parts = text.encode(), []
    for lo in range(0, max(1, len(raw)), q.PASSAGE):
        x = np.concatenate([f for _, f in q.passage_features([raw[lo : lo + q.PASSAGE]])])[0].astype(float)
        trust = x[-1] / (x[-1] + q.SHORT)
        x = [(v - m) / s * trust for v, m, s in zip(x[:-1], model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(a * b for a, b in zip(x, column, strict=True)) + e) for column, e in zip(model.p["E"].T, model.p["e"], strict=True)]
        gate = [math.tanh(sum(a * b for a, b in zip(h, v, strict=True))) / (1 + math.exp(-sum(a * b for a, b in zip(h, u, strict=True)))) for v, u in zip(model.p["V"].T, model.p["U"].T, strict=True)]
        parts.append((math.exp(sum(a * b for a, b in zip(gate, model.p["w"], strict=True))), h))
    total = sum(w for w, _ in parts)
    z = [sum(w * h[j] for w, h in parts) / total for j in range(q.HIDDEN)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, model.p["c"], strict=True)) - model.p["b"][0]))


def test_scores_are_those_of_the_forward_pass(spark):
    df, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = q.fit_quality(df, labels)
    got = {r.doc_id: r.score for r in q.classify_quality(df, labels).collect()}
    rows = sorted(df.collect(), key=lambda r: len(r.text))
    for r in rows[:10] + rows[90:100] + rows[-3:]:
        # bigrams and grams that cross the border of two passages count in the operator and not here
        assert abs(got[r.doc_id] - score(model, r.text)) < (1e-4 if len(r.text.encode()) <= q.PASSAGE else 0.05)


def test_the_fit_takes_one_text_for_each_key_and_no_more_passages_than_allowed(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    texts = [f"text {i} of some words " * (i % 7 + 1) for i in range(40)]
    once, twice = docs(spark, texts), docs(spark, texts * 50, list(range(40)) * 50)
    a, b = q.fit_quality(once, labels), q.fit_quality(twice, labels)
    assert all(np.allclose(a.p[k], b.p[k], atol=1e-6) for k in a.p)
    assert q.fit_quality(once, labels, max_passages=0) is None
