"""Runs of words that repeat with a period, found by probing a harmonic grid.

For each period p the words at jp and (j + 1)p are compared, which is n / p tests and n log n for all periods. A run of length 4p or more
holds three such tests in a row; where three hold, the stretch is extended by comparing arrays in chunks. Grid points that lie in a stretch
that is known already, or in a run whose period divides p, are passed over: a stretch of p that holds one such pair has the shorter period throughout.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import word_slices

#: Least length of a run in words, and in periods.
LEAST, PERIODS = 6, 4
CHUNK = 1 << 16
#: Bytes of texts that a task hands on at once.
OUT = 1 << 22
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _forward(w: np.ndarray, i: int, p: int) -> int:
    """The first place from i on where w differs from itself p words on; the last one to compare is len(w) - p - 1."""
    end, size = len(w) - p, 64
    while i < end:
        m = min(i + size, end)
        differs = w[i:m] != w[i + p : m + p]
        if differs.any():
            return i + int(differs.argmax())
        i, size = m, min(2 * size, CHUNK)
    return end


def _backward(w: np.ndarray, i: int, p: int) -> int:
    """The least place down from i such that w equals itself p words on from there to i."""
    size = 64
    while i > 0:
        m = max(0, i - size)
        differs = w[m:i] != w[m + p : i + p]
        if differs.any():
            return i - int(differs[::-1].argmax())
        i, size = m, min(2 * size, CHUNK)
    return 0


def _probed(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(p, grid points j) by ascending p, where the words at jp, (j + 1)p, (j + 2)p and (j + 3)p are equal.

    Up to the root of n a period at a time; beyond it a grid point at a time for all periods, as those have few points each.
    """
    n = len(w)
    top = n // PERIODS
    few = min(top, isqrt(n))
    for p in range(1, few + 1):
        grid = w[::p]
        same = grid[:-1] == grid[1:]
        j = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(j):
            yield p, j
    if top <= few:
        return
    first, periods, points = few + 1, [], []
    same = []
    for j in range((n - 1) // first):
        last = min(top, (n - 1) // (j + 1))
        here = w[j * first : j * last + 1 : j] if j else w[0]
        same.append(here == w[(j + 1) * first : (j + 1) * last + 1 : j + 1])
        if len(same) == 3:
            m = len(same[2])
            p = np.flatnonzero(same[0][:m] & same[1][:m] & same[2])
            if len(p):
                periods.append(p + first)
                points.append(np.full(len(p), j - 2))
            same.pop(0)
    if not periods:
        return
    p, j = np.concatenate(periods), np.concatenate(points)
    order = np.lexsort((j, p))
    p, j = p[order], j[order]
    cuts = np.flatnonzero(np.diff(p)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(p)], strict=True):
        yield int(p[lo]), j[lo:hi]


def word_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of w, by start, then period.

    A run is a stretch with smallest period p and length of at least max(LEAST, PERIODS * p) that no neighbour extends.
    """
    n = len(w)
    if n < LEAST:
        return []
    found: dict[int, tuple[list[int], list[int]]] = {}
    for p, points in _probed(w):
        divisors = [d for d in found if p % d == 0]
        at = 0
        while at < len(points):
            i = int(points[at]) * p
            end = None
            for d in divisors:
                starts, ends = found[d]
                k = bisect_right(starts, i) - 1
                if k >= 0 and i + p < ends[k]:
                    end = max(end or 0, ends[k] - p)
            if end is None:
                start, end = _backward(w, i, p), _forward(w, i, p)
                if end - start + p >= max(LEAST, PERIODS * p):
                    starts, ends = found.setdefault(p, ([], []))
                    starts.append(start)
                    ends.append(end + p)
            at = max(at + 1, int(np.searchsorted(points, -(-end // p))))
    return sorted((s, e - s, p) for p, (starts, ends) in found.items() for s, e in zip(starts, ends, strict=True))


def repeated_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks of the words that some run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) > 0


def numbered_words(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the words by number; long texts are split a slice at a time."""
    numbers: dict[bytes, int] = {}
    parts = [np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int32, len(words)) for words in word_slices(raw)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(numbers)


def implanted(key: int | None, n: int) -> tuple[int, int] | None:
    """For one key in ten (by crc32): from word a on the text repeats its p words after a. A null key is left as it is."""
    if key is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(key).encode()), 10)
    if rest:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs: all runs by start, then period, and the text without their repetitions.

    collapsed joins by a blank the words that no run holds after its first period. rewrite(key, number of words) can give (a, p): each word
    i from a on then becomes word a + (i - a) mod p before runs are sought. Words are cut at blanks and the characters 9 to 13.
    A null or empty text has no words, no runs and an empty collapsed text; null keys are kept; repeated rows are answered one by one;
    other columns play no part; bytes that are no UTF-8 are compared and kept as they are. A task holds a text's words as numbers and its distinct words.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", kind), ("collapsed", pa.binary())])

        def pack(out):
            ids, counts, runs, kept = zip(*out, strict=True)
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), listed.cast(kind), pa.array(kept, pa.binary())], schema=schema)

        for batch in batches:
            out, size = [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers, words = numbered_words(value.as_py() or b"")
                n = len(numbers)
                if rewrite and (to := rewrite(doc, n)):
                    a, p = to
                    numbers = np.concatenate([numbers[:a], numbers[a + np.arange(n - a) % p]])
                runs = word_runs(numbers)
                left = numbers[~repeated_words(n, runs)] if runs else numbers
                kept = b" ".join(b" ".join([words[k] for k in left[lo : lo + CHUNK].tolist()]) for lo in range(0, len(left), CHUNK))
                out.append((doc, n, runs, kept))
                size += len(kept) + 24 * len(runs)
                if size > OUT:
                    yield pack(out)
                    out, size = [], 0
            if out:
                yield pack(out)

    found = rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digests(found: DataFrame) -> DataFrame:
    """What periodic_runs tells, as numbers of the longest run (ties: smallest start, then period; without runs null) and digests."""
    longest = F.expr("aggregate(runs, get(runs, 0), (x, y) -> CASE WHEN y.length > x.length THEN y ELSE x END)")
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("top"), told.alias("told"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.col("told").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
