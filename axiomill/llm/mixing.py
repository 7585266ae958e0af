"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks. With its weight w, an exact fraction, block i of a source is released at floor(i / w)
and due at ceil((i + 1) / w); earliest deadline first among the released blocks picks one block a slot. One slot per
block is feasible for these windows, so no block is late and a source is less than one block from its weight at
any time, however long the input. The driver passes over the blocks once (MAX_BLOCKS at most, as blocks grow with the input unless their rows are given) and keeps only where each
CUT of the schedule begins; tasks lay the cuts out again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, staged

MAX_SOURCES = 100_000
#: Rows of a block, unless they are given.
BLOCK_ROWS = 16
#: Blocks in all, about: unless their rows are given, a larger input has larger blocks, so the driver's part does not grow with it.
MAX_BLOCKS = 1 << 22
#: Blocks of the schedule that a task lays out at once, at least; 8 per source where that is more.
CUT = 4096


def schedule(parts: list[int], blocks: list[int], slot: int = 0, begun: list[int] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, source, block, release, deadline) by earliest deadline first, in order of slots, from `slot` on.

    Source s weighs parts[s] / sum(parts) and has blocks[s] blocks, of which begun[s] have had their slots.
    """
    total, waiting, ready = sum(parts), [], []

    def wait(s: int, i: int, at: int) -> None:
        if i < blocks[s]:
            heapq.heappush(waiting, (max(i * total // parts[s], at), s, i))

    for s in range(len(parts)):
        wait(s, begun[s] if begun else 0, slot)
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // parts[s]), s, i))
        due, s, i = heapq.heappop(ready)
        yield slot, s, i, i * total // parts[s], due
        slot += 1
        wait(s, i + 1, slot)


def whole_parts(weights: list) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(f.denominator for f in exact))
    parts = [f.numerator * (scale // f.denominator) for f in exact]
    shared = math.gcd(*parts) or 1
    return [p // shared for p in parts]


def capped_shares(counts: dict, max_share: float) -> dict:
    """Target weights, exact fractions: the natural shares, but none above max_share (or twice an equal split, if that is more)."""
    limit = min(Fraction(1), max(Fraction(max_share), Fraction(2, max(1, len(counts)))))
    held: set = set()
    while True:
        free = sum(n for k, n in counts.items() if k not in held)
        scale = max(Fraction(0), 1 - limit * len(held)) / free if free else Fraction(0)
        over = {k for k, n in counts.items() if k not in held and n * scale > limit}
        if not over:
            return {k: limit if k in held else n * scale for k, n in counts.items()}
        held |= over


def digest(text):
    """64 bits of a text; a null text has its own."""
    return F.xxhash64(F.md5(text), F.xxhash64(text))


def mix_sources(docs: DataFrame, weights: dict | None = None, max_share: float = 0.25, block_rows: int | None = None, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, source, block, release, deadline, slot, position, in_mix.

    Blocks have exactly block_rows rows where that is given; unless it is, BLOCK_ROWS, or 1 / MAX_BLOCKS of all rows if that is more. Slots are block times of the schedule; a block has its slot within its own window, so slots can stay unused once a source is
    empty. The mix ends with the last slot of the
    sources at or below their natural share: to there every source is within one block of its weight while it lasts.
    What a source above its target weight has left after it is surplus (in_mix false), returned all the same. Rows are
    ordered by position, gapless from 0. A null source is a source of its own, null keys are keys like others.
    Rows equal in key, source and text count as one and share its place, so a position then names several rows.
    Sources of any size are ranked in slices. More than MAX_SOURCES sources raise ValueError: their table is held on
    the driver. Given weights must name every source but may be any positive numbers.
    """
    spark = docs.sparkSession
    unit_keys = ["doc_id", "source", "__digest"]
    rows = staged(docs.select(docs[key].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), digest(docs[text]).alias("__digest")), "mix-rows")
    units = rows.distinct()
    counts = {r[0]: r[1] for r in units.groupBy("source").count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // MAX_BLOCKS))
    target = {k: weights[k] for k in counts} if weights else capped_shares(counts, max_share)
    names = sorted(counts, key=str)
    parts, sizes = whole_parts([target[k] for k in names]), [counts[k] for k in names]
    blocks = [-(-c // block_rows) for c in sizes]
    n, w = sum(sizes), sum(parts)
    per_cut, cuts, begun, ends, before = max(CUT, 8 * len(names)), [], [0] * len(names), [0] * len(names), 0
    for at, (slot, s, i, _, _) in enumerate(schedule(parts, blocks)):
        if at % per_cut == 0:
            cuts.append((slot, before, list(begun)))
        begun[s], ends[s] = i + 1, slot
        before += min(block_rows, sizes[s] - i * block_rows)
    last = max((e for e, p, c in zip(ends, parts, sizes, strict=True) if p * n >= c * w or len(names) == 1), default=0)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, before, begun in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for (at, s, i, release, due), _ in zip(schedule(parts, blocks, slot, begun), range(per_cut), strict=False):
                    out.append((names[s], i, release, due, at, before))
                    before += min(block_rows, sizes[s] - i * block_rows)
                types = [pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["__source", "__block", "release", "deadline", "slot", "__before"])

    begins = spark.createDataFrame(cuts, "slot long, before long, begun array<long>")
    plan = begins.mapInArrow(lay_out, "__source string, __block long, release long, deadline long, slot long, __before long")
    out = ranked(units, ["source"], ["doc_id", "__digest"], "__rank", n).withColumn("block", F.floor(F.col("__rank") / block_rows).cast("long"))
    out = out.join(plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block")))
    position = F.col("__before") + F.col("__rank") % block_rows
    out = out.select(*(F.col(k).alias(f"__u_{k}") for k in unit_keys), "block", "release", "deadline", "slot", position.alias("position"), (F.col("slot") <= last).alias("in_mix"))
    same = [F.col(k).eqNullSafe(F.col(f"__u_{k}")) for k in unit_keys]
    return rows.join(out, same).select("doc_id", "source", "block", "release", "deadline", "slot", "position", "in_mix", "__digest")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """All rows of docs, with all their columns, sorted over all partitions by their position; surplus comes after the mix.

    Nulls, ties and repeated rows are placed as mix_sources tells; rows that share a place all stay. An empty table stays empty.
    """
    plan = mix_sources(docs, key=key, source=source, text=text, **how)
    plan = plan.select(F.struct("doc_id", "source", F.col("__digest").alias("digest")).alias("unit"), "position").distinct()
    unit = F.struct(docs[key].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), digest(docs[text]).alias("digest"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), unit.alias("of"))  # packed, so no name of theirs clashes
    return rows.join(plan, F.col("of").eqNullSafe(F.col("unit"))).sort("position").select("row.*")
