"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (PASSAGE bytes each, all of its text). Every passage becomes a vector of byte statistics, a
learned layer encodes it, gated attention weighs the passages, and the weighted sum is scored. Labels exist for documents alone,
so attention learns which passages decide. The fit runs on the driver on at most `max_fit` labelled documents, chosen by the hash of their
id; scoring is a map over all documents with a model of a few thousand numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import readable

PASSAGE = 512
BIGRAMS = 96
OCCUPANCY = 512
HIDDEN = 16
ATTENTION = 8
CHUNK = 1 << 19
#: Byte classes whose shares are features, in order; all bytes from 0x80 are one more class.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "|", "!", ".", ",", "#$%&*", "\"'()-:;?", "<>[]{}\\/=_+~^`@")
_CLASS = np.full(256, len(CLASSES), np.int64)
_CLASS[:128] = len(CLASSES) + 1
for _i, _s in enumerate(CLASSES):
    _CLASS[np.frombuffer(_s.encode(), np.uint8)] = _i
N_CLASSES = len(CLASSES) + 2
FEATURES = N_CLASSES + BIGRAMS + 2
SHORT = 100


def _chunk_features(raw: np.ndarray, passage: np.ndarray, last: np.ndarray, count: int) -> np.ndarray:
    """Features of `count` passages, their length last; passage: each byte's, last: bytes that end a text (no n-gram crosses them)."""
    out = np.zeros((count, FEATURES), np.float32)
    if not len(raw):
        out[:, -1] = 1
        return out
    length = np.maximum(np.bincount(passage, minlength=count), 1)[:, None]
    out[:, :N_CLASSES] = np.bincount(passage * N_CLASSES + _CLASS[raw], minlength=count * N_CLASSES).reshape(count, -1) / length
    wide = raw.astype(np.uint32)
    pair = (wide[:-1] * np.uint32(257) + wide[1:]) * np.uint32(2654435761)
    inside = ~last[:-1]
    hist = np.bincount((passage[:-1] * BIGRAMS + (pair >> np.uint32(8)) % np.uint32(BIGRAMS))[inside], minlength=count * BIGRAMS)
    out[:, -1] = length[:, 0]
    out[:, N_CLASSES:-2] = np.sqrt(hist.reshape(count, -1) / length)
    if len(raw) > 5:
        gram = (pair[:-4] ^ (pair[2:-2] * np.uint32(40503)) ^ (pair[4:] * np.uint32(69069))) * np.uint32(2246822519)
        here = passage[:-5]
        ok = here == passage[5:]
        seen = np.zeros(count * OCCUPANCY, bool)
        seen[(here * OCCUPANCY + (gram >> np.uint32(12)) % np.uint32(OCCUPANCY))[ok]] = True
        out[:, -2] = seen.reshape(count, -1).sum(axis=1) / (OCCUPANCY * (1 - np.exp(-np.maximum(length[:, 0], 1) / OCCUPANCY)))
    return out


def passage_features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index of each passage, features), a chunk of at most about CHUNK bytes at a time; long texts span chunks."""
    pending: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        lengths = np.array([len(b) for _, b in pending])
        passages = np.maximum(1, -(-lengths // PASSAGE))
        first, start = np.cumsum(passages) - passages, np.cumsum(lengths) - lengths
        raw = np.frombuffer(b"".join(b for _, b in pending), np.uint8)
        at = np.arange(len(raw)) - np.repeat(start, lengths)
        last = np.zeros(len(raw), bool)
        last[(start + lengths - 1)[lengths > 0]] = True
        feats = _chunk_features(raw, np.repeat(first, lengths) + at // PASSAGE, last, int(passages.sum()))
        return np.repeat(np.array([i for i, _ in pending]), passages), feats

    for i, text in enumerate(texts):
        for lo in range(0, max(1, len(text)), CHUNK):
            pending.append((i, text[lo : lo + CHUNK]))
            size += len(pending[-1][1]) + PASSAGE
            if size >= CHUNK:
                yield flush()
                pending, size = [], 0
    if pending:
        yield flush()


class AttentionMIL:
    """Encoder, gated attention and scorer in numpy; bags are given as rows of instances with their bag's number."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = len(mean) - 1
        self.mean, self.scale = mean[:-1].astype(np.float32), scale[:-1].astype(np.float32)
        shapes = {"E": (d, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "b": (1,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s)) for k, s in shapes.items()}

    def _standard(self, x: np.ndarray) -> np.ndarray:
        """Deviations from the mean passage; what a short passage shows is noise for the greater part, so it counts for less."""
        return (x[:, :-1] - self.mean) / self.scale * (x[:, -1:] / (x[:, -1:] + SHORT))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoding and attention logit of each passage."""
        p = self.p
        h = np.tanh(self._standard(x) @ p["E"] + p["e"])
        return h, (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]

    @staticmethod
    def _weights(logit: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, logit)
        raised = np.exp(logit - top[bag])
        return raised / np.bincount(bag, raised, bags)[bag]

    def pool(self, h: np.ndarray, logit: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
        """Probability of label 1 for each bag."""
        a = self._weights(logit, bag, bags)
        z = np.stack([np.bincount(bag, a * h[:, j], bags) for j in range(HIDDEN)], axis=1)
        return 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["b"], -30, 30)))

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Full-batch Adam on the mean log loss, both classes weighing alike."""
        p, bags = self.p, len(y)
        x = self._standard(x).astype(np.float64)
        share = np.where(y == 1, y.mean(), 1 - y.mean())
        cost = 1 / np.maximum(share, 1e-9)
        cost /= cost.sum()
        m, v = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
        for t in range(1, steps + 1):
            h = np.tanh(x @ p["E"] + p["e"])
            tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
            a = self._weights((tv * su) @ p["w"], bag, bags)
            z = np.stack([np.bincount(bag, a * h[:, j], bags) for j in range(HIDDEN)], axis=1)
            dy = (1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30))) - y) * cost
            dz = dy[:, None] * p["c"]
            da = (dz[bag] * h).sum(axis=1)
            dl = a * (da - np.bincount(bag, a * da, bags)[bag])
            dg = dl[:, None] * p["w"]
            dtv, dsu = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
            dh = (a[:, None] * dz[bag] + dtv @ p["V"].T + dsu @ p["U"].T) * (1 - h**2)
            g = {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dtv, "U": h.T @ dsu, "w": (tv * su).T @ dl, "c": z.T @ dy, "b": dy.sum(keepdims=True)}
            for k in p:
                grad = g[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def _held_out(key):
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_fit: int = 4000, max_passages: int = 100_000) -> AttentionMIL | None:
    """A model from labelled rows whose crc32(key) mod 3 is not 1; None if there are none.

    At most max_fit documents, in the order of the hash of their key, as far as they have no more than max_passages passages in
    all (one that exceeds what is left is passed over): that bounds what reaches the driver. A key with several labels counts with the
    highest, one with several texts with the first in code order.
    """
    known = labels.select(labels[key].cast("long").alias("__k"), labels[label].cast("int").alias("__y")).where(F.col("__k").isNotNull() & F.col("__y").isNotNull() & ~_held_out(F.col("__k")))
    known = known.groupBy("__k").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__k"), "__k").limit(max_fit)
    rows = docs.select(docs[key].cast("long").alias("__d"), F.coalesce(readable(docs[text]), F.lit("")).alias("__t"))
    rows = rows.where(F.octet_length("__t") <= max_passages * PASSAGE).join(F.broadcast(known), F.col("__d") == F.col("__k"))
    rows = rows.groupBy("__k", "__y").agg(F.min("__t").alias("__t"))
    left, chosen = max_passages, []
    for r in sorted(rows.select("__k", F.octet_length("__t").alias("n"), F.xxhash64("__k").alias("h")).collect(), key=lambda r: (r.h, r[0])):
        passages = max(1, -(-r.n // PASSAGE))
        if passages <= left:
            chosen.append((r[0],))
            left -= passages
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "__c long")), F.col("__k") == F.col("__c"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            found: list[list[np.ndarray]] = [[] for _ in texts]
            for index, feats in passage_features(texts):
                for i in np.unique(index):
                    found[i].append(feats[index == i])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.concatenate(f).tobytes() for f in found], pa.binary())], names=["k", "y", "x"])

    got = sorted(rows.mapInArrow(run, "k long, y int, x binary").collect(), key=lambda r: r.k)
    if not got:
        return None
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    x, bag = np.concatenate(xs), np.repeat(np.arange(len(xs)), [len(f) for f in xs])
    model = AttentionMIL(x.mean(axis=0), x.std(axis=0) + 0.02)
    model.fit(x, bag, np.array([1.0 if r.y >= 1 else 0.0 for r in got]))
    return model


def quality_scorer(model: AttentionMIL | None):
    """A Pandas UDF text -> probability of label 1; 0.5 without a model. A null text is scored like an empty one."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        raw = [(t or "").encode() for t in texts]
        out = np.full(len(raw), 0.5)
        if model is None or not raw:
            return pd.Series(out)
        parts = [(i, *model.encode(f)) for i, f in passage_features(raw)]
        bag = np.concatenate([i for i, _, _ in parts])
        out = model.pool(np.concatenate([h for _, h, _ in parts]), np.concatenate([a for _, _, a in parts]), bag, len(raw))
        return pd.Series(out)

    return score


def classify_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_fit: int = 4000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null keys are kept and count as not held out; repeated rows are answered one by one; other columns play no part.
    """
    model = fit_quality(docs, labels, key, text, max_fit=max_fit)
    scored = docs.select(docs[key].cast("long").alias("doc_id"), quality_scorer(model)(readable(docs[text])).alias("score"))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score at least `least`, by default those that classify_quality predicts 1; without a model all of them.

    A null text is scored like an empty one, rows are judged one by one, so repeated ones fare alike; an empty table stays empty.
    """
    return docs.where(quality_scorer(fit_quality(docs, labels, key, text))(readable(docs[text])) >= least)
