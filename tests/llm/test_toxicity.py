import random
import zlib
from collections import Counter

import numpy as np
import pytest

from axiomill.llm import toxicity as t
from tests.conftest import MIDDLE, SMALL

from .helpers import docs, none, odd

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    df, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = {r.doc_id: r for r in t.classify_toxicity(df, labels).collect()}
    assert len(got) == df.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p for p, y in held if y]) >= 0.8 and np.mean([p for p, y in held if not y]) <= 0.03


def test_held_out_labels_play_no_part(spark):
    df, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = spark.createDataFrame([(r.doc_id, r.quality, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.toxic) for r in labels.collect()], labels.schema)
    a, b = ({r.doc_id: round(r.score, 9) for r in t.classify_toxicity(df, x).collect()} for x in (labels, turned))
    assert a == b


def test_swapped_terms_lose_the_weight_that_their_company_gave_them(spark):
    rng = random.Random(4)
    plain = lambda n: " ".join(rng.choice("bread river stone garden letter window morning market story bridge".split()) for _ in range(n))
    texts, labels = [], []
    for i in range(600):
        toxic = i % 2
        group = "muslims" if toxic and rng.random() < 0.9 else "christians" if rng.random() < 0.3 else "people"
        insult = rng.choice(["idiots", "scum", "trash", "vermin", "morons", "filth"]) + " " if toxic and rng.random() < 0.7 else ""
        texts.append(f"The {group} {insult}of the {plain(6)}. {plain(8)}.")
        labels.append((i, 1, toxic))
    df, known = docs(spark, texts), spark.createDataFrame(labels, LABELS)
    neutral = [b"the muslims of the town bake bread.", b"the christians of the town bake bread.", b"the people of the town bake bread."]
    free, held = (t.fit_toxicity(df, known, strength=x).scores(neutral) for x in (0.0, 4.0))
    assert free[0] >= 0.7 and free[0] - free[1] > 0.3
    assert held[0] < 0.7 and np.ptp(held) < 0.1
    assert t.fit_toxicity(df, known).scores([b"the muslims scum of the bread.", b"the people scum trash of the bread."]).min() >= 0.7


def test_swapped_sentences():
    pairs = list(t.swapped_sentences("nothing here. the men and women met the jews! no menace.", most=5))
    assert all(a == " the men and women met the jews" for a, _ in pairs)
    changed = {b for _, b in pairs}
    assert " the girls and boys met the jews" not in changed and " the girls and men met the jews" in changed and " the men and women met the hindus" in changed and " the men and women met the people" in changed
    assert list(t.swapped_sentences("the men. the men.", (("men", "women"),), most=1)) == [("the men", "the women")]


def slow_features(text):
    """Words, their beginnings and the pieces inside them, as strings, and those among them that come again."""
    out, word = Counter(), b""
    for c in text + b" ":
        if t._LETTER[c]:
            word += bytes([c])
            continue
        if word:
            out.update([(1, word), *((2, word[:k]) for k in t.BEGINNINGS if len(word) >= k), *((3, word[i : i + t.PIECE]) for i in range(len(word) - t.PIECE + 1))])
        word = b""
    return {*out, *((k, n, "again") for (k, n), times in out.items() if times > 1)}


def test_features_are_those_of_the_plain_definition_whatever_stands_beside_them(monkeypatch):
    texts = [b"", b"a", "the überquick brown foxes' den".encode(), b"word " * 300 + b"wording", b"x1y2z3w4 x1y2z3w4q"]
    alone = [t.text_features([x])[1] for x in texts]
    assert [len(a) for a in alone] == [len(slow_features(x)) for x in texts]
    monkeypatch.setattr(t, "CHUNK", 97)
    t._powers.cache_clear()
    text, found = t.text_features(texts)
    assert all(np.array_equal(np.sort(found[text == i]), np.sort(alone[i])) for i in range(len(texts)))
    t._powers.cache_clear()


def test_scores_are_those_of_the_chosen_features_one_by_one(spark):
    df, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = t.fit_toxicity(df, labels)
    weight = dict(zip(model.chosen.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in t.classify_toxicity(df, labels).collect()}
    for r in df.limit(60).collect():
        z = model.bias + sum(weight.get(h, 0.0) for h in set(t.text_features([r.text.lower().encode()])[1].tolist()))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (7, None, 0), (5, 0, 0), (4, 1, None), (3, 1, 1), (8, 0, 0)], LABELS)
    assert t.classify_toxicity(odd(spark), labels).count() == 12
    assert t.classify_toxicity(none(spark), labels).collect() == []
    assert {r.score for r in t.classify_toxicity(odd(spark), labels.limit(0)).collect()} == {0.5}
    kept = t.drop_toxic(odd(spark), labels.limit(0))
    assert kept.count() == 12 and kept.columns == odd(spark).columns


@pytest.mark.parametrize("text", ["", "x", "a fine sentence of words.", None])
def test_scores_are_finite(spark, text):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1), (5, 0, 1)], LABELS)
    assert 0 <= t.classify_toxicity(docs(spark, [text, "y", "z", "z", "z", "q"]), labels).collect()[0].score <= 1


def test_bytes_that_are_no_utf8_and_words_without_end(spark):
    df = spark.sql("SELECT 3L AS doc_id, CAST(unhex('6162FF20') AS STRING) AS text UNION ALL SELECT 4L, repeat('x', 1300000)")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1)], LABELS)
    assert t.classify_toxicity(df, labels).count() == 2


def test_the_fit_takes_one_text_for_each_key(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], LABELS)
    texts = [f"text {'bad' if i % 2 else 'good'}word of some words " * (i % 7 + 1) for i in range(40)]
    a, b = t.fit_toxicity(docs(spark, texts), labels), t.fit_toxicity(docs(spark, texts * 20, list(range(40)) * 20), labels)
    assert np.array_equal(a.chosen, b.chosen) and np.allclose(a.weights, b.weights)
