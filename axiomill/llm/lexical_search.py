"""Ranked lexical search: integer BM25 scores, by windows of documents.

Documents become postings of the queries' terms once, which is all that is kept of their texts. Postings are dealt by ranges of doc_id. A task walks its
documents in windows of fixed width in doc_id: a window's postings lie term by term, each with its contribution worked out once; for each query they
are added into an array of one slot per document, small enough for a core's cache, with a bitset of the slots that were met; what stands there is
harvested into the query's heap, and the array is cleared where the bitset says so. Tasks hand on their heaps, which are merged in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, staged, unstaged
from .words import word_slices

#: Documents of a window, and the most that its arrays hold at once: 128 KB of scores.
WINDOW = 1 << 14
#: Bytes of terms that one pass over the documents looks for.
PASS_BYTES = 8 << 20
#: Rows that a task's postings come from, about.
TASK_ROWS = 1 << 18
#: Terms are runs of digits, letters and characters beyond ASCII; A to Z count as a to z.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_slices(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists."""
    return word_slices(raw.translate(_TERMS))


def _binary(df: DataFrame, column: str):
    return df[column].cast("string").cast("binary")


def _query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, terms): the distinct terms of each row, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t for words in term_slices(v.as_py() or b"") for t in words}) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    return queries.select(queries[key].cast("long").alias("item_id"), _binary(queries, text).alias("raw")).mapInArrow(run, "item_id long, terms array<binary>")


def _postings(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times, spread): each document's length in terms, and numbers and counts of the vocabulary's terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, missing = vocabulary.get, len(vocabulary)
        for batch in batches:
            lengths, sizes, terms, times = [], [], [], []
            for value in batch.column(1):
                n, seen = 0, []
                for words in term_slices(value.as_py() or b""):
                    n += len(words)
                    number, count = np.unique(np.fromiter((get(t, missing) for t in words), np.int32, len(words)), return_counts=True)
                    seen.append((number[number < missing], count[number < missing]))
                number, count = (np.concatenate([s[k] for s in seen]) if seen else np.zeros(0, np.int32) for k in (0, 1))
                if len(seen) > 1:
                    number, back = np.unique(number, return_inverse=True)
                    count = np.bincount(back, count, len(number)).astype(np.int64)
                lengths.append(n)
                sizes.append(len(number))
                terms.append(number)
                times.append(count)
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(kind))) for x, kind in ((terms, np.int32), (times, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    rows = docs.select(docs[key].cast("long").alias("doc_id"), _binary(docs, text).alias("raw")).mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")
    return rows.withColumn("spread", F.xxhash64("n", "terms", "times"))


class _Heaps:
    """The best documents of each query so far: (score, -place in doc_id order); documents come by ascending doc_id."""

    def __init__(self, queries: list[np.ndarray], best: int):
        self.queries, self.best = queries, best
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in queries]
        self.scores = np.zeros(WINDOW, np.int64)
        self.met = np.zeros(WINDOW, bool)

    def window(self, ids: np.ndarray, slots: np.ndarray, terms: np.ndarray, gains: np.ndarray, place: int) -> None:
        """Score a window: one entry per posting, in the order of term; ids by slot, slots by ascending doc_id."""
        starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        at = {int(t): (int(lo), int(hi)) for t, lo, hi in zip(terms[starts], starts, [*starts[1:], len(terms)], strict=True)}
        scores, met, m = self.scores, self.met, len(ids)
        for query, heap in zip(self.queries, self.heaps, strict=True):
            ranges = [at[t] for t in query if t in at]
            if not ranges:
                continue
            for lo, hi in ranges:
                here = slots[lo:hi]
                scores[here] += gains[lo:hi]
                met[here] = True
            bits = np.packbits(met[:m])
            some = np.flatnonzero(bits)
            rows, place_in = np.nonzero(np.unpackbits(bits[some]).reshape(-1, 8))
            found = 8 * some[rows] + place_in
            least = heap[0][0] if len(heap) == self.best else 0
            better = found[scores[found] > least]
            if len(better) > self.best:
                order = np.lexsort((better, -scores[better]))[: self.best]
                better = np.sort(better[order])
            for slot in better.tolist():
                entry = (int(scores[slot]), -(place + slot), int(ids[slot]))
                if len(heap) < self.best:
                    heapq.heappush(heap, entry)
                elif entry[0] > heap[0][0]:
                    heapq.heapreplace(heap, entry)
            scores[found] = 0
            met[found] = False


def _scored(postings: DataFrame, weights: np.ndarray, queries: list[np.ndarray], n_docs: int, n_terms: int, best: int, width: int) -> DataFrame:
    """(query, doc_id, score): each task's best documents. Rows of a task come by ascending doc_id; a missing one is NO_ID."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, place, sets = _Heaps([q.tolist() for q in queries], best), 0, []

        def score(parts) -> int:
            ids = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            sizes = np.concatenate([p[2] for p in parts])
            terms, times = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
            slots = np.repeat(np.arange(len(ids)), sizes)
            norm = 100 - 50 + (50 * n * n_docs) // max(1, n_terms)
            gains = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * norm[slots]))
            order = np.lexsort((slots, terms))
            heaps.window(ids, slots[order], terms[order], gains[order], place)
            return len(ids)

        def cut(parts, final: bool):
            """Score all whole windows of parts; what may go on stays. A window ends with its ids, or when its arrays are full."""
            nonlocal place
            ids = np.concatenate([p[0] for p in parts])
            ends = np.flatnonzero(ids[1:] // width != ids[:-1] // width) + 1
            bounds, lo = [], 0
            for hi in [*ends.tolist(), *([len(ids)] if final else [])]:
                bounds += [(a, min(a + WINDOW, hi)) for a in range(lo, hi, WINDOW)]
                lo = hi
            if not final:
                while len(ids) - lo >= WINDOW:
                    bounds.append((lo, lo + WINDOW))
                    lo += WINDOW
            n, sizes = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
            terms, times = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
            first = np.concatenate([[0], np.cumsum(sizes)])
            for a, b in bounds:
                place += score([(ids[a:b], n[a:b], sizes[a:b], terms[first[a] : first[b]], times[first[a] : first[b]])])
            return [(ids[lo:], n[lo:], sizes[lo:], terms[first[lo] :], times[first[lo] :])]

        for batch in batches:
            lists = [batch.column(k) for k in (2, 3)]
            sizes = np.diff(lists[0].offsets.to_numpy()).astype(np.int64)
            sets.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), sizes, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()))
            sets = cut(sets, False)
        if sets:
            cut(sets, True)
        out = [(q, doc, score) for q, heap in enumerate(heaps.heaps) for score, _, doc in heap]
        for lo in range(0, len(out), 1 << 16):
            q, doc, points = zip(*out[lo : lo + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(doc, pa.int64()), pa.array(points, pa.int64())], names=["query", "doc_id", "score"])

    return postings.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "n", "terms", "times").mapInArrow(run, "query int, doc_id long, score long")


def _best(df: DataFrame, keys: list[str], best: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", best: int = 50, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of queries its best documents with a score above 0, equal scores by ascending doc_id.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's score the sum of w * (1000000000 tf div (1000 tf + 20 m)) with
    m = 50 + 50 n N div L. N and L count all documents with terms and all their terms. Queries go in blocks of about pass_bytes of terms, each one
    pass over the documents, so what a task holds of them is bounded. A null text has no terms. Rows with the same doc_id are documents of their own and
    those without one come last among equals; rows of queries with the same item_id or none are answered each by itself. Empty tables give no rows, other
    columns play no part, bytes that are no UTF-8 are parts of terms.
    """
    spark = docs.sparkSession
    asked = staged(_query_terms(queries, item, text), "search-queries")
    size = F.coalesce(F.expr("aggregate(terms, 0L, (s, t) -> s + octet_length(t) + 16)"), F.lit(0)) + 16
    total = asked.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // pass_bytes))
    results = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).orderBy("item_id", "terms").collect()
        items, sets = [r.item_id for r in mine], [r.terms for r in mine]
        words = sorted({bytes(t) for terms in sets for t in terms})
        if not words:
            continue
        vocabulary = {t: k for k, t in enumerate(words)}
        postings = staged(_postings(docs, key, text, vocabulary), "search-postings")
        sums = postings.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
        n_docs, n_terms, low, high, rows = sums[0], sums[1] or 0, sums[2] or 0, sums[3] or 0, sums[4]
        df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(words))], np.int64)
        width = max(1, (high - low + 1) // max(1, rows)) * WINDOW
        tasks = max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
        dealt = postings.where(F.size("terms") > 0).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
        dealt = dealt.repartitionByRange(tasks, "doc_id", "spread").sortWithinPartitions("doc_id", "spread")
        numbers = [np.array([vocabulary[bytes(t)] for t in terms], np.int32) for terms in sets]
        heaps = _scored(dealt, weights, numbers, n_docs, n_terms, best, width)
        merged = _best(_best(heaps.withColumn("part", F.spark_partition_id() % math.isqrt(tasks)), ["query", "part"], best), ["query"], best)
        named = spark.createDataFrame([(k, i) for k, i in enumerate(items)], "query int, item_id long")
        answer = merged.join(F.broadcast(named), "query").select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
        results.append(staged(answer, "search"))
        unstaged(postings)
    unstaged(asked)
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
