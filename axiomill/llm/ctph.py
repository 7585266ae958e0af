"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last 7 bytes decides where pieces end; each piece gives one character of the signature. The
block size sets how often pieces end: 3 * 2**k, the smallest that leaves at most about 64 pieces. A fingerprint is
`block size:signature:signature at twice the block size`, so texts whose sizes differ by a factor of two compare.
Likeness is one minus the edit distance of the signatures at a common block size over the longer one's length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, readable

LEAST_BLOCK = 3
PIECES = 64
COMMON = 4
SLICE = 1 << 22
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_P = [np.uint32(pow(0x01000193, k, 1 << 32)) for k in range(7)]


def _ends(raw: np.ndarray, block: int) -> np.ndarray:
    """Positions after which a piece ends at this block size, a slice of the text at a time."""
    found = []
    for lo in range(0, len(raw), SLICE):
        part = np.zeros(min(SLICE, len(raw) - lo) + 6, np.uint32)  # six bytes of context before it
        have = min(6, lo)
        part[6 - have :] = raw[lo - have : lo + SLICE]
        one = part
        two = one[1:] + _P[1] * one[:-1]
        three = two[1:] + _P[2] * one[:-2]
        four = two[2:] + _P[2] * two[:-2]
        seven = four[3:] + _P[4] * three[:-4]
        seven = (seven * np.uint32(2654435761)) >> np.uint32(7)
        found.append(np.flatnonzero(seven % np.uint32(block) == block - 1) + lo)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _signature(view: memoryview, ends: np.ndarray, most: int) -> str:
    """One character per piece; pieces beyond the most allowed join the last one."""
    out, lo = [], 0
    for hi in ends[: most - 1].tolist():
        out.append(_CHARS[zlib.crc32(view[lo : hi + 1]) & 63])
        lo = hi + 1
    if lo < len(view):
        out.append(_CHARS[zlib.crc32(view[lo:]) & 63])
    return "".join(out)


def fingerprint(raw: bytes) -> str:
    array, view = np.frombuffer(raw, np.uint8), memoryview(raw)
    block = LEAST_BLOCK
    while block * PIECES < len(raw):
        block *= 2
    least = max(LEAST_BLOCK, block // 8)
    fine = _ends(array, least) if raw else np.zeros(0, np.int64)
    hash_of = {}

    def at(size: int) -> np.ndarray:
        # an end at a block size is one at each smaller size too, so the coarse ones are among the fine ones
        if size not in hash_of:
            hash_of[size] = fine if size == least else _among(array, fine, size)
        return hash_of[size]

    while block > least and len(at(block)) < PIECES // 2:
        block //= 2
    return f"{block}:{_signature(view, at(block), PIECES)}:{_signature(view, at(2 * block), PIECES // 2)}"


def _among(raw: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Those of the positions at which a piece ends at a larger block size."""
    total = np.zeros(len(ends), np.uint32)
    for back in range(7):
        at = ends - back
        total += np.where(at >= 0, raw[np.maximum(at, 0)], 0).astype(np.uint32) * _P[back]
    total = (total * np.uint32(2654435761)) >> np.uint32(7)
    return ends[total % np.uint32(block) == block - 1]


def _alike(a: Column, b: Column) -> Column:
    """Likeness of two signatures at one block size; long ones need COMMON characters in a row in common."""
    grams = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - COMMON + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(COMMON)))
    short = F.least(F.length(a), F.length(b)) < COMMON
    ratio = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(short | F.arrays_overlap(grams(a), grams(b)), ratio).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints; 0 if their block sizes differ by more than a factor of two."""
    pa_, pb = F.split(a, ":"), F.split(b, ":")
    block = lambda p: F.get(p, F.lit(0)).cast("long")
    sig = lambda p, i: F.get(p, F.lit(i))
    same = F.greatest(_alike(sig(pa_, 1), sig(pb, 1)), F.when((sig(pa_, 2) != "") & (sig(pb, 2) != ""), _alike(sig(pa_, 2), sig(pb, 2))).otherwise(0.0))
    return F.when(a == b, 1.0).when(block(pa_) == block(pb), same).when(block(pa_) == 2 * block(pb), _alike(sig(pa_, 1), sig(pb, 2))).when(2 * block(pa_) == block(pb), _alike(sig(pa_, 2), sig(pb, 1))).otherwise(0.0)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 20_000) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses (see SCHEMA, near_edited, near_next).

    The edited text ends in the beginning of the next document by descending key. Key ranges are dealt to tasks; the
    first document of each range is sent to the range above it as well, so every document finds the next one in its own
    task and texts are shuffled once. A null text is empty; null keys come last; rows with one key are
    ordered by the hash of their text, so repeated rows follow each other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NULL_ID)).alias("__id"), docs[key].cast("long").alias("doc_id"), F.coalesce(readable(docs[text]), F.lit("")).alias("text"))
    count = rows.count()
    if not count:
        return spark.createDataFrame([], SCHEMA + ", near_edited double, near_next double").drop("next_fingerprint")
    buckets = min(20_000, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), count // rows_per_bucket))
    found = rows.agg(F.percentile_approx("__id", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("b")).first()[0]
    bounds = np.unique(np.array(found, np.int64))
    bucket_of = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="left").astype("int32")), "int")
    heads = sorted((r[0], r[1]) for r in rows.select("__id", bucket_of("__id").alias("b")).groupBy("b").agg(F.max("__id")).collect())
    also = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}
    head_ids = np.array(sorted(also), np.int64)
    head_to = np.array([also[h] for h in sorted(also)], np.int32)

    @F.pandas_udf("array<struct<bucket:int,ghost:int>>")
    def dealt(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy()
        own, at = np.searchsorted(bounds, values, side="left"), np.minimum(np.searchsorted(head_ids, values), len(head_ids) - 1)
        is_head = head_ids[at] == values
        return pd.Series([[(int(b), 0), (int(head_to[a]), 1)] if h else [(int(b), 0)] for b, a, h in zip(own, at, is_head, strict=True)])

    placed = rows.withColumn("__to", F.explode(dealt("__id"))).select("__to.bucket", "__to.ghost", "__id", "doc_id", "text")
    placed = placed.repartition("bucket").sortWithinPartitions("bucket", "ghost", F.desc("__id"), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None  # the row that waits for its next one; a bucket whose ghost has come
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for bucket, ghost, doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if ghost and bucket == done:
                    continue
                mark = fingerprint(t.encode())
                if held is not None:
                    own_id, own, own_mark = held
                    half = len(own) // 2
                    edited = (own[: len(own) - half] + t[:half]).encode()
                    for c, v in zip(out, (own_id, len(own), hashlib.sha256(edited).hexdigest(), own_mark, fingerprint(edited), mark), strict=True):
                        c.append(v)
                held, done = (None, bucket) if ghost else ((doc_id, t, mark), done)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.string()) for i, c in enumerate(out)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    made = placed.mapInArrow(run, SCHEMA)
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
