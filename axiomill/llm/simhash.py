"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of 8 bytes gives 8 positional bytes. Fingerprints within k bits differ in at most k bytes, so they share
at least 8 - k of them: the guaranteed minimum. Postings of single bytes would hold 1/256 of all fingerprints each, and tallying
a pair's shared bytes over them would visit nearly every pair. So the index keeps a posting for each choice of GROUPS - k groups of two
bytes out of four: k bits touch k groups at most, so every pair that can reach the minimum meets in one. Two that meet share four bytes or more
by chance; the tally of all positional bytes turns away those under the minimum, and the others are verified by their distance.
A posting of more than LARGE fingerprints is not gathered: its members go on to postings of 8 - k equal bytes, which hold at most 2 ** (8 * k).
Links leave a posting as a star around the smallest of each linked set: no pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.operators.components import connected_components

from .common import NO_ID, readable, staged
from .words import word_slices

SEED = 42
#: Groups of positional bytes, and the most fingerprints that one posting of whole groups may hold.
GROUPS, LARGE = 4, 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, the highest first."""
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(raw[:, i], minlength=256) @ _BITS for i in range(8)])


def majority(votes: np.ndarray, count: int) -> int:
    """The number whose bits are those that over half of `count` hashes have."""
    return int.from_bytes(np.packbits(votes * 2 > count).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a whole text (unsigned): a bit is 1 if over half the shingles' hashes have it."""
    votes, n, tail = np.zeros(64, np.int64), 0, []
    for part in word_slices((text or "").encode().lower()):
        w = tail + part
        tail = w[-(words - 1) :] if words > 1 else []
        if len(w) < words:
            tail = w
            continue
        shingles = zip(*(w[i:] for i in range(words)), strict=False)
        hashes = np.frombuffer(b"".join(xxhash.xxh64_digest(b" ".join(s), SEED) for s in shingles), ">u8")
        n += len(hashes)
        votes += bit_votes(hashes)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return majority(votes, n)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp as signed long), a map over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(docs[key].cast("long").alias("doc_id"), readable(docs[text]).alias("text")).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=None)
def _masks(k: int, free: int) -> np.ndarray:
    """All masks of 1 to k bits among the bits of `free`."""
    bits = [1 << b for b in range(64) if free >> b & 1]
    return np.array([sum(c) for n in range(1, k + 1) for c in combinations(bits, n)], np.uint64)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally of a pair: how many positional bytes are equal, from the pair's exclusive or."""
    return np.count_nonzero(np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0, axis=-1)


def verified(x: np.ndarray, k: int) -> np.ndarray:
    """Count filter, then distance: whether pairs (given by their exclusive or) reach the minimum of shared bytes and, of these, differ in at most k bits."""
    out = shared_bytes(x) >= 8 - k
    out[out] = np.bitwise_count(x[out]) <= k
    return out


def linked(values: np.ndarray, k: int, free: int) -> np.ndarray:
    """For each of the sorted distinct values, the smallest value linked to it within the posting (signed order is not used).

    In a large posting all pairs that differ by one mask are tallied and verified at once, mask by mask.
    """
    n = len(values)
    label = np.arange(n)
    if n <= 256:
        near = verified(values[:, None] ^ values[None, :], k)
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            if (new == label).all():
                return values[label]
            label = new
    steps = []
    masks = _masks(k, free)
    for mask in masks[verified(masks, k)]:
        at = np.minimum(np.searchsorted(values, values ^ mask), n - 1)
        hit = np.flatnonzero(values[at] == values ^ mask)
        if len(hit):
            steps.append((hit, at[hit]))
    while True:
        before = label.copy()
        for hit, at in steps:
            label[hit] = np.minimum(label[hit], label[at])
        label = label[label]
        if (label == before).all():
            return values[label]


def _free(kept: list[tuple[int, ...]]) -> list[int]:
    """For each set of kept positions the mask of the bits left free."""
    return [sum(255 << 8 * p for p in range(8) if p not in some) for some in kept]


def _keyed(nodes: DataFrame, free: list[int]) -> DataFrame:
    """(fp, c, shared): each fingerprint under what it has outside each free mask."""
    signed = [int(np.array([~np.uint64(m)]).view(np.int64)[0]) for m in free]
    keys = F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(signed)))
    return nodes.select("fp", F.explode(keys).alias("p")).select("fp", "p.c", "p.shared")


def _met(postings: DataFrame, free: list[int], k: int) -> DataFrame:
    """Star links (a, b) of postings (c, fps)."""

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def met(c: pd.Series, fps: pd.Series) -> pd.Series:
        groups = [np.sort(np.asarray(f, np.int64).view(np.uint64)) for f in fps]
        out: list[list] = [[] for _ in groups]
        two = [i for i, g in enumerate(groups) if len(g) == 2]
        if two:  # most postings are pairs: all of them at once
            pairs = np.stack([groups[i] for i in two])
            signed_pairs = pairs.view(np.int64).tolist()
            for j in np.flatnonzero(verified(pairs[:, 0] ^ pairs[:, 1], k)).tolist():
                out[two[j]] = [(signed_pairs[j][1], signed_pairs[j][0])]
        for i, (which, values) in enumerate(zip(c, groups, strict=True)):
            if len(values) > 2:
                root = linked(values, k, free[which])
                moved = root != values
                out[i] = list(zip(values[moved].view(np.int64).tolist(), root[moved].view(np.int64).tolist(), strict=True))
        return pd.Series(out)

    return postings.where(F.size("fps") > 1).select(F.explode(met("c", "fps")).alias("e")).select("e.a", "e.b")


def links(nodes: DataFrame, k: int = 2) -> DataFrame:
    """Star links (a, b) that connect exactly the fingerprints within k bits of each other; nodes has distinct fp."""
    whole = [tuple(p for g in some for p in (2 * g, 2 * g + 1)) for some in combinations(range(GROUPS), max(0, GROUPS - k))]
    every = list(combinations(range(8), max(0, 8 - k)))
    dealt = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))  # small rows that become many
    gathered = lambda rows: rows.groupBy("c", "shared").agg(F.collect_list("fp").alias("fps"))
    if k >= GROUPS:
        return _met(gathered(_keyed(dealt, _free(every))), _free(every), k).distinct()
    keyed = _keyed(dealt, _free(whole))
    large = staged(keyed.groupBy("c", "shared").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select(F.col("c").alias("__c"), F.col("shared").alias("__s")), "large")
    same = (F.col("c") == F.col("__c")) & (F.col("shared") == F.col("__s"))
    if large.isEmpty():
        return _met(gathered(keyed), _free(whole), k).distinct()
    small = _met(gathered(keyed.join(large, same, "left_anti")), _free(whole), k)
    rest = keyed.join(large, same, "left_semi").select("fp").distinct()
    return small.union(_met(gathered(_keyed(rest, _free(every))), _free(every), k)).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest key that can be reached over links of at most `bits` differing bits. Rows with equal
    fingerprints are one node from the start, so copies are never paired. A null or empty text has fingerprint 0 and
    links like any other; null keys are kept and are nobody's component_id unless a component has no other. Repeated rows and
    ties give repeated results. Empty tables give empty results; texts of any length are read a slice at a time.
    """
    rows = staged(fingerprints(docs, key, text, words), "simhash")
    nodes = rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first"))
    # a node is named by its smallest key, so the smallest name of a component is the answer already
    name = F.struct(F.col("first").alias("id"), F.col("fp").alias("fp"))
    left, right = (nodes.select(F.col("fp").alias(f"__{c}"), name.alias(f"name_{c}")) for c in "ab")
    met = links(nodes.select("fp"), bits)
    met = met.join(left, F.col("a") == F.col("__a")).join(right, F.col("b") == F.col("__b")).select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    roots = connected_components(met).select(F.col("node.fp").alias("__n"), F.col("root.id").alias("__least"))
    named = nodes.join(roots, F.col("fp") == F.col("__n"), "left").select(F.col("fp").alias("__fp"), F.nullif(F.coalesce("__least", "first"), F.lit(NO_ID)).alias("component_id"))
    return rows.join(named, F.col("fp") == F.col("__fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
