"""Benchmark decontamination with an FM-index per training shard.

The test phrases are the windows of WINDOW consecutive words of the benchmark items. Their words are the alphabet; a word that
is in no phrase can't be inside an occurrence, so it is a boundary in the shard's sequence. Each shard (a run of documents of bounded length
in one task) gets an index: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix,
and sampled suffix positions. All phrases are searched backwards at once, occurrences are located by
walking to a sampled position, and the word spans they cover are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import readable, staged
from .words import word_slices

WINDOW = 10
SAMPLE = 8
SHARD_WORDS = 1 << 20
#: Benchmark text that one pass holds (its windows take about ten times that); a larger benchmark is searched in as many passes as it takes.
PASS_BYTES = 8 << 20
#: A-Z in lower case; all other bytes that no word holds as spaces. Words hold 0-9, a-z and bytes from 0x80.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, a slice at a time."""
    return word_slices((text or "").encode().translate(_FOLD))


class Phrases:
    """The distinct windows of a list of (item id, text), packed: ids of their words, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            ids = [np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in part), np.int32, len(part)) for part in words_of(text)]
            row = np.concatenate([*ids, np.zeros(0, np.int32)])
            if len(row):
                parts.setdefault(min(window, len(row)), []).append((row, at[item]))
        #: length -> (numbers of the phrases, their words)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        owners, phrases, n = [], [], 0
        for length, rows in sorted(parts.items()):
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(row, length) for row, _ in rows])
            owner = np.repeat([i for _, i in rows], [len(row) - length + 1 for row, _ in rows])
            order = np.lexsort((owner, *windows.T[::-1]))
            windows, owner = windows[order], owner[order]
            new = np.concatenate([[True], (windows[1:] != windows[:-1]).any(axis=1)])
            phrase = np.cumsum(new) - 1 + n
            once = np.concatenate([[True], (np.diff(phrase) != 0) | (np.diff(owner) != 0)])
            self.by_length[length] = (np.arange(n, n + int(new.sum())), windows[new])
            owners.append(owner[once])
            phrases.append(phrase[once])
            n += int(new.sum())
        self.owners = np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate([*phrases, np.zeros(0, np.int64)]).astype(np.int64), minlength=n))]).astype(np.int64)
        self.shortest = min(self.by_length, default=0)

    def items_of(self, phrases: np.ndarray) -> list[str]:
        """The items, sorted, that any of these phrases belongs to."""
        sizes = self.begin[phrases + 1] - self.begin[phrases]
        at = np.repeat(self.begin[phrases] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return [self.names[i] for i in np.unique(self.owners[at]).tolist()]


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector per bit of the alphabet, with counts before each word of 64 bits."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.n, self.levels = len(sequence), []
        now = sequence
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((level, words, before, int(self.n - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at
        for level, words, before, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            ends = []
            for i in (lo, hi):
                word = i >> 6
                ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
                ends.append(np.where(one, zeros + ones, i - ones))
            lo, hi = ends
        return hi - lo


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; each boundary (0) is a symbol of its own, by position."""
    n = len(sequence)
    rank = np.where(sequence == 0, 0, sequence + n).astype(np.int64)
    rank[sequence == 0] = np.arange(int((sequence == 0).sum()))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    def __init__(self, sequence: np.ndarray, alphabet: int):
        """sequence: word ids from 1, with 0 as boundary between runs and at the end."""
        sa = suffix_array(sequence)
        self.bwt = sequence[sa - 1]  # of the first suffix: the last symbol, a boundary
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=alphabet + 1))])
        self.ranks = WaveletMatrix(self.bwt, max(1, int(alphabet).bit_length()))
        self.marked = (sa % SAMPLE == 0) | (self.bwt == 0)  # a walk never has to cross a boundary
        self.slot = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each phrase (rows of equal length); empty where it doesn't occur."""
        lo, hi = self.first[phrases[:, -1]].copy(), self.first[phrases[:, -1] + 1].copy()
        live = np.flatnonzero(lo < hi)
        for j in range(phrases.shape[1] - 2, -1, -1):
            if not len(live):
                break
            c = phrases[live, j]
            lo[live] = self.first[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.first[c] + self.ranks.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes of these rows."""
        at, steps, left = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(left := left[~self.marked[at[left]]]):
            c = self.bwt[at[left]]
            at[left] = self.first[c] + self.ranks.rank(c, at[left])
            steps[left] += 1
        return self.samples[self.slot[at]] + steps


class Shard:
    """Documents whose runs of phrase words await one index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.docs, self.size = phrases, [], 0
        self.parts: list[np.ndarray] = []
        self.where: list[np.ndarray] = []

    def add(self, text: str | None) -> int:
        """Append a text; returns its number of words."""
        get, at, ids = self.phrases.vocabulary.get, 0, []
        for part in words_of(text):
            ids.append(np.fromiter(map(get, part, repeat(0)), np.int64, len(part)))
            at += len(part)
        ids.append(np.zeros(1, np.int64))
        row = np.concatenate(ids)
        # runs too short for any phrase hold none; of each other run the word after it, a boundary, is kept as well
        inside = row > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= max(1, self.phrases.shortest)
        begin, end = begin[long], end[long] + 1
        lengths = end - begin
        kept = np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        self.parts.append(row[kept])
        self.where.append(kept)
        self.size += len(kept)
        return at

    def hits(self) -> list[tuple[list[int], list[str]]]:
        """For each text: merged word spans (start, end, start, end, ...) and the items found; then the shard is empty."""
        out: list[tuple[list[int], list[str]]] = [([], []) for _ in self.parts]
        if self.size:
            sequence, where = np.concatenate(self.parts), np.concatenate(self.where)
            doc = np.repeat(np.arange(len(self.parts)), [len(p) for p in self.parts])
            index = FMIndex(sequence, len(self.phrases.vocabulary))
            found = []
            for length, (names, phrases) in self.phrases.by_length.items():
                lo, hi = index.search(phrases)
                some = np.flatnonzero(lo < hi)
                counts = hi[some] - lo[some]
                rows = np.repeat(lo[some] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
                at = index.locate(rows)
                found.append(np.stack([doc[at], where[at], where[at] + length, np.repeat(names[some], counts)], axis=1))
            spans = np.concatenate(found)
            spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
            for part in np.split(spans, np.flatnonzero(np.diff(spans[:, 0])) + 1):
                if len(part):
                    top = np.maximum.accumulate(part[:, 2])
                    cut = np.flatnonzero(part[1:, 1] > top[:-1]) + 1
                    begin, end = part[np.concatenate([[0], cut]), 1], top[np.concatenate([cut - 1, [len(part) - 1]])]
                    items = self.phrases.items_of(np.unique(part[:, 3]))
                    out[int(part[0, 0])] = (np.stack([begin, end], axis=1).reshape(-1).tolist(), items)
        self.parts, self.where, self.size = [], [], 0
        return out


def _merged(flat: list[int]) -> list[int]:
    out: list[int] = []
    for lo, hi in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def _passes(benchmark: DataFrame, text: str, item: str, window: int) -> Iterator[tuple[bool, Phrases]]:
    """(whether it is the last, phrases) of PASS_BYTES of the benchmark at a time."""
    known = benchmark.select(F.coalesce(benchmark[item].cast("string"), F.lit("")).alias("i"), F.coalesce(readable(benchmark[text]), F.lit("")).alias("t")).distinct()
    n = max(1, -(-int(known.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]) // PASS_BYTES))
    for k in range(n):
        part = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else known
        yield k == n - 1, Phrases([(r.i, r.t) for r in part.collect()], window)


def _cleanness(phrases: Phrases):
    """A Pandas UDF text -> whether no phrase occurs in it; each batch is a shard, or several."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        shard, out = Shard(phrases), []
        for t in texts:
            shard.add(t)
            if shard.size >= SHARD_WORDS:
                out += [not spans for spans, _ in shard.hits()]
        return pd.Series(out + [not spans for spans, _ in shard.hits()], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no window of a benchmark item occurs; no shuffle.
    A benchmark of several passes is searched in as many rounds, each of what the one before has kept.

    A null or empty text has no words and stays; rows are judged one by one, so repeated ones fare alike. Empty tables
    on either side drop nothing.
    """
    for last, phrases in _passes(benchmark, text, item, window):
        docs = docs.where(_cleanness(phrases)(readable(docs[text])))
        if not last:
            docs = staged(docs, "clean")
    return docs


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, spans array<long>, items array<string>), a map over docs.

    spans holds start and end (exclusive) of the merged removal spans, counted in words. A null text has no words,
    null keys are kept, repeated rows are answered one by one. A null item id counts as the empty one. Empty
    tables give no hits. The benchmark is held PASS_BYTES at a time. Where that
    takes several passes, texts are staged once, each pass is a job of its own that tells its hits, and these are merged by row.
    """
    schema = "row long, doc_id long, n_words long, spans array<long>, items array<string>"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    told = ["doc_id", "n_words", "spans", "items"]

    def searched(rows: DataFrame, phrases: Phrases) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held = Shard(phrases), []

            def flush() -> pa.RecordBatch:
                out = [(*row, spans, items) for row, (spans, items) in zip(held, shard.hits(), strict=True)]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

            size = 0
            for batch in batches:
                for row, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    n = shard.add(text)
                    held.append((row, doc, n))
                    size += n
                    if shard.size >= SHARD_WORDS or size >= 16 * SHARD_WORDS:
                        yield flush()
                        size = 0
            if held:
                yield flush()

        return rows.mapInArrow(run, schema)

    rows = docs.select(F.lit(0).cast("long").alias("row"), docs[key].cast("long").alias("doc_id"), readable(docs[text]).alias("text"))
    found: list[DataFrame] = []
    for last, phrases in _passes(benchmark, text, item, window):
        if last and not found:
            return searched(rows, phrases).select(told)
        if not found:
            rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "searched")
        hits = searched(rows, phrases)
        found.append(staged(hits.where(F.size("spans") > 0) if found else hits, "hits"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    merged = F.pandas_udf(lambda spans: pd.Series([_merged([int(x) for x in s]) for s in spans]), "array<long>")
    flat = lambda c: F.flatten(F.collect_list(c))
    whole = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), flat("spans").alias("spans"), F.array_sort(F.array_distinct(flat("items"))).alias("items"))
    return whole.withColumn("spans", merged("spans")).select(told)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Digest columns of find_contamination: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, key, text, item, window)
    pairs = F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))
    hit = F.when(F.size("spans") > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, i: acc + F.get("spans", i + 1) - F.get("spans", i))).otherwise(0)
    found = found.withColumn("n_hit", hit.cast("long"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")
