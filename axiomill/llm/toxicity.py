"""Toxicity by a classifier that is held to equal scores when identity terms are swapped.

A text is the set of its words, of their beginnings and of five-byte pieces inside them, all hashed, and of those of them that it repeats. From a bounded sample of labelled documents the
features that tell the classes apart best are chosen, and a logistic regression on their presence is fit. Every sentence of the sample that
names a group is also read with the group's name swapped for the others of its kind and for a neutral word; the squared change of the
score's logit over these pairs is added to the loss. So a mention of a group carries little weight of its own, however often the toxic
documents of the sample mention it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstaged
from .quality import _held_out

#: Names of groups by kind; the last word of a kind is its neutral one.
IDENTITY = (
    ("women", "men", "girls", "boys", "females", "males", "people"),
    ("woman", "man", "girl", "boy", "female", "male", "person"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "people"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "local"),
    ("black", "white", "asian", "african", "latino", "european", "arab", "local"),
    ("mexican", "chinese", "indian", "american", "german", "french", "russian", "local"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer", "local"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "people"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young", "local"),
    ("frauen", "männer", "mädchen", "jungen", "leute"),
    ("muslime", "christen", "juden", "ausländer", "flüchtlinge", "leute"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "gens"),
    ("mujeres", "hombres", "niñas", "niños", "gente"),
    ("musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "gente"),
)
BEGINNINGS = (4, 5, 6, 7, 8)
PIECE = 5
CHUNK = 1 << 19
#: Features that are chosen, and the least documents of a class and deviations from chance that one needs.
FEATURES, SUPPORT, DEVIATIONS = 4096, 3, 3.0
#: Sentences of one document that are read with swapped terms.
SWAPPED = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
#: Turns the hash of a feature into that of its being repeated, and back.
_REPEATED = np.uint64(0x5555AAAA5555AAAA)
_SENTENCE = re.compile(r"[^.!?\n]+")


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(CHUNK + 2, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all features of lower-case bytes, CHUNK at most."""
    up, down = _powers()
    n = len(raw)
    letter = _LETTER[raw]
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    of = lambda s, e, kind: _mixed((total[e] - total[s]) * down[s], kind)
    places, hashes = [starts], [of(starts, ends, 1)]
    for k in BEGINNINGS:
        s = starts[ends - starts >= k]
        places.append(s)
        hashes.append(of(s, s + k, 2))
    if n >= PIECE:
        run = np.concatenate([[0], np.cumsum(letter)])
        s = np.flatnonzero(run[PIECE:] - run[:-PIECE] == PIECE)
        places.append(s)
        hashes.append(of(s, s + PIECE, 3))
    return np.concatenate(places), np.concatenate(hashes)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of at most CHUNK bytes, cut at blanks where there are any."""
    at = 0
    while len(raw) - at > CHUNK:
        end = raw.rfind(b" ", at + 1, at + CHUNK)
        end = end if end > at else at + CHUNK
        yield raw[at:end]
        at = end
    yield raw[at:]


def _lower(value: bytes | None) -> bytes:
    return (value or b"").decode("utf-8", "replace").lower().encode()


def _counted_pairs(text: np.ndarray, found: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (text, found) once, with the sum of its times."""
    order = np.lexsort((found, text))
    text, found, times = text[order], found[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (found[1:] != found[:-1])])) if len(text) else np.zeros(0, np.int64)
    return text[first], found[first], np.add.reduceat(times, first) if len(first) else times


def _occurring(texts: list[bytes], keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of lower-case texts; keep(hashes) gives (mask, features) of what counts, else all hashes."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pending: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        raw = np.frombuffer(b"\n".join(b for _, b in pending), np.uint8)
        first = np.cumsum([0, *(len(b) + 1 for _, b in pending)])
        places, found = _hashed(raw)
        if keep:
            mask, found = keep(found)
            places = places[mask]
        text = np.array([i for i, _ in pending])[np.searchsorted(first, places, "right") - 1]
        out.append(_counted_pairs(text, found, np.ones(len(text), np.int64)))

    for i, value in enumerate(texts):
        for piece in _pieces(value):
            if pending and size + len(piece) + 1 > CHUNK:
                flush()
                pending, size = [], 0
            pending.append((i, piece))
            size += len(piece) + 1
    if pending:
        flush()
    return _counted_pairs(*(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)))


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all features of lower-case texts, each pair once."""
    text, found, times = _occurring(texts)
    again = times > 1
    return np.concatenate([text, text[again]]), np.concatenate([found, found[again] ^ _REPEATED])


def _finder(chosen: np.ndarray):
    """texts -> (text, place in chosen) of their chosen features; chosen is sorted. A table of the hashes' upper bits is asked first."""
    plain = np.union1d(chosen, chosen ^ _REPEATED)
    table = np.zeros(1 << 20, bool)
    table[(plain >> np.uint64(44)).astype(np.int64)] = True

    def place(hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(chosen, hashes), max(0, len(chosen) - 1))
        return np.where(chosen[at] == hashes, at, -1) if len(chosen) else np.full(len(hashes), -1)

    once, again = place(plain), place(plain ^ _REPEATED)

    def keep(hashes: np.ndarray):
        near = np.flatnonzero(table[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(plain, hashes[near]), max(0, len(plain) - 1))
        same = plain[at] == hashes[near] if len(plain) else np.zeros(0, bool)
        return near[same], at[same]

    def find(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text, at, times = _occurring(texts, keep)
        text, at = np.concatenate([text, text[times > 1]]), np.concatenate([once[at], again[at[times > 1]]])
        order = np.lexsort((at, text))
        order = order[at[order] >= 0]
        return text[order], at[order]

    return find


def swapped_sentences(text: str, kinds: Sequence[Sequence[str]] = IDENTITY, most: int = SWAPPED) -> Iterator[tuple[str, str]]:
    """(sentence, the same with one kind's terms swapped) for the first `most` sentences of a lower-case text that name a group.

    A term becomes each other term of its kind in turn, the neutral one among them.
    """
    of = {t: kind for kind in kinds for t in kind[:-1]}
    names = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, of), key=len, reverse=True)) + r")\b")
    for m in _SENTENCE.finditer(text):
        if most <= 0:
            return
        found = names.findall(m[0])
        if not found:
            continue
        most -= 1
        for kind in dict.fromkeys(of[t] for t in found):
            for k in range(1, len(kind)):
                yield m[0], names.sub(lambda t, kind=kind, k=k: kind[(kind.index(t[0]) + k) % len(kind)] if of[t[0]] is kind else t[0], m[0])


class PairedLogit:
    """Logistic regression on sets of features with a penalty on the change of the logit over pairs."""

    def __init__(self, chosen: np.ndarray):
        self.chosen = chosen
        self.weights, self.bias = np.zeros(len(chosen)), 0.0

    def fit(self, row: np.ndarray, feature: np.ndarray, y: np.ndarray, pair: np.ndarray, moved: np.ndarray, sign: np.ndarray, strength: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> None:
        """row, feature: what the documents hold; pair, moved, sign: features that a swap brings (1) or takes (-1). Both classes weigh alike."""
        k, n, pairs = len(self.chosen), len(y), int(pair.max()) + 1 if len(pair) else 0
        share = np.where(y == 1, y.mean(), 1 - y.mean())
        cost = 1 / np.maximum(share, 1e-9)
        cost /= cost.sum()
        w = np.zeros(k + 1)
        m, v = np.zeros(k + 1), np.zeros(k + 1)
        for t in range(1, steps + 1):
            z = np.bincount(row, w[feature], n) + w[k]
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
            grad = np.concatenate([np.bincount(feature, dz[row], k) + decay * w[:k], [dz.sum()]])
            if pairs:
                change = np.bincount(pair, sign * w[moved], pairs)
                grad[:k] += np.bincount(moved, sign * change[pair], k) * 2 * strength / pairs
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.bias = w[:k], float(w[k])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities for lower-case texts."""
        text, at = _finder(self.chosen)(texts)
        z = np.bincount(text, self.weights[at], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_fit: int) -> DataFrame:
    """(k, y, raw): at most half of max_fit documents of each label, in the order of the hash of their key."""
    known = labels.select(labels[key].cast("long").alias("k"), labels[label].cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~_held_out(F.col("k")))
    known = known.groupBy("k").agg((F.max("y") >= 1).cast("int").alias("y"))
    half = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(max_fit // 2)
    rows = docs.select(docs[key].cast("long").alias("d"), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("raw"))
    rows = rows.join(F.broadcast(half(0).unionByName(half(1))), F.col("d") == F.col("k"))
    return staged(rows.groupBy("k", "y").agg(F.min("raw").alias("raw")), "toxicity-sample")


def _counted(sample: DataFrame) -> DataFrame:
    """(hash, n1, n0): documents of each label that hold a feature; a task adds up its own before it hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), np.int64)
            text, found = text_features([_lower(v.as_py()) for v in batch.column(1)])
            hashes, back = np.unique(found, return_inverse=True)
            of = [np.bincount(back, y[text] == k, len(hashes)).astype(np.int64) if len(hashes) else np.zeros(0, np.int64) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.uint64).view(np.int64)), *map(pa.array, of)], names=["hash", "n1", "n0"])

    return sample.select("y", "raw").mapInArrow(run, "hash long, n1 long, n0 long").groupBy("hash").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_fit: int = 12_000, features: int = FEATURES, strength: float = 4.0, kinds: Sequence[Sequence[str]] = IDENTITY) -> PairedLogit | None:
    """A model from labelled rows whose crc32(key) mod 3 is not 1; None unless both labels occur among them.

    At most max_fit documents, half of each label; their texts stay with the executors, and the driver gets the numbers of at most `features`
    chosen features (and the groups' names) for each, two bytes a number. strength weighs the change of the logit under swapped terms. A key with several labels counts
    with the highest, one with several texts with the first in byte order.
    """
    sample = _sample(docs, labels, key, text, label, max_fit)
    size = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(size) < 2:
        unstaged(sample)
        return None
    names = sorted({t for kind in kinds for t in kind})
    forced = np.unique(np.concatenate([_hashed(np.frombuffer(t.encode(), np.uint8))[1][:1] for t in names])) if names else np.zeros(0, np.uint64)
    pooled = (F.col("n1") + F.col("n0")) / (size[1] + size[0])
    told = F.try_divide(F.abs(F.col("n1") / size[1] - F.col("n0") / size[0]), F.sqrt(pooled * (1 - pooled) * (1 / size[1] + 1 / size[0])))
    best = _counted(sample).where(F.greatest("n1", "n0") >= SUPPORT).withColumn("told", told).where(F.col("told") >= DEVIATIONS)
    picked = [r.hash for r in best.orderBy(F.desc("told"), "hash").select("hash").limit(features).collect()]
    chosen = np.union1d(np.array(picked, np.int64).view(np.uint64), forced)
    if len(chosen) > 1 << 16:
        raise ValueError(f"more than {1 << 16} features")
    find = _finder(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_lower(v.as_py()) for v in batch.column(2)]
            rows, at = find(texts)
            cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
            held = [at[a:b].astype("<u2").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            moves = []
            for value in texts:
                pairs = list(swapped_sentences(value.decode(), kinds))
                side, place = find([s.encode() for p in pairs for s in p])
                sets = [set(place[side == i].tolist()) for i in range(2 * len(pairs))]
                moves.append([[*sorted(sets[2 * i + 1] - sets[2 * i]), *(-1 - x for x in sorted(sets[2 * i] - sets[2 * i + 1]))] for i in range(len(pairs))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary()), pa.array(moves, pa.list_(pa.list_(pa.int32())))], names=["k", "y", "held", "moves"])

    got = sorted(sample.select("k", "y", "raw").mapInArrow(run, "k long, y int, held binary, moves array<array<int>>").collect(), key=lambda r: r.k)
    unstaged(sample)
    row = np.repeat(np.arange(len(got)), [len(r.held) // 2 for r in got])
    feature = np.frombuffer(b"".join(bytes(r.held) for r in got), "<u2").astype(np.int64)
    swaps = [m for r in got for m in r.moves if m]
    pair = np.repeat(np.arange(len(swaps)), [len(m) for m in swaps]).astype(np.int64)
    moved = np.array([x for m in swaps for x in m], np.int64)
    model = PairedLogit(chosen)
    model.fit(row, feature, np.array([float(r.y) for r in got]), pair, np.where(moved < 0, -1 - moved, moved), np.where(moved < 0, -1.0, 1.0), strength)
    return model


def toxicity_scorer(model: PairedLogit | None):
    """A Pandas UDF bytes of a text -> probability of label 1; 0.5 without a model. A null text is scored like an empty one."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.scores([_lower(t) for t in texts]) if model is not None and len(texts) else np.full(len(texts), 0.5))

    return score


def classify_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.7, max_fit: int = 12_000, strength: float = 4.0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; predicted is 1 from a score of `least` on.

    Null keys are kept and count as not held out; a null text is scored like an empty one; repeated rows are answered one by one; other columns
    play no part; bytes that are no UTF-8 are read as replacement characters. Words are cut after CHUNK bytes. Empty tables give empty results, and without
    labels of both kinds every score is 0.5.
    """
    model = fit_toxicity(docs, labels, key, text, max_fit=max_fit, strength=strength)
    scored = docs.select(docs[key].cast("long").alias("doc_id"), toxicity_scorer(model)(docs[text].cast("string").cast("binary")).alias("score"))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score below `least`; without a model all of them. Cases as in classify_toxicity."""
    return docs.where(toxicity_scorer(fit_toxicity(docs, labels, key, text))(docs[text].cast("string").cast("binary")) < least)
