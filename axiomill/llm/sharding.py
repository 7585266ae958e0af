"""Sharding by best-fit-decreasing bin packing with a balanced tree of remaining capacities.

Indivisible groups (rows with equal texts) are packed whole. What the packing needs to know of the groups is only how
many there are of each size, so the driver holds a histogram of bounded length, never the groups: a size counts with its first
DIGITS binary digits, rounded up (at most 2 ** (DIGITS - 1) classes for each power of two), which is exact up to 64 KiB and within 1/32,768 beyond. Groups
of one class are interchangeable, and best fit puts equal groups into the same bin until it is full, so
packing a run of equal groups at once gives the very result of packing them one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_order, ranked, staged
from .mixing import digest as mix_digest

DIGITS = 16


class CapacityTree:
    """A balanced (AVL) tree of (remaining capacity, bin): insert, remove and the tightest that fits in O(log n)."""

    class _Node:
        __slots__ = ("key", "left", "right", "height")

        def __init__(self, key):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self):
        self.root = None

    @staticmethod
    def _h(n):
        return n.height if n else 0

    def _fix(self, n):
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        tilt = self._h(n.left) - self._h(n.right)
        if tilt > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._turn(n.left, "right", "left")
            return self._turn(n, "left", "right")
        if tilt < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._turn(n.right, "left", "right")
            return self._turn(n, "right", "left")
        return n

    def _turn(self, n, up, down):
        top = getattr(n, up)
        setattr(n, up, getattr(top, down))
        setattr(top, down, n)
        for x in (n, top):
            x.height = 1 + max(self._h(x.left), self._h(x.right))
        return top

    def insert(self, key):
        def put(n):
            if n is None:
                return self._Node(key)
            side = "left" if key < n.key else "right"
            setattr(n, side, put(getattr(n, side)))
            return self._fix(n)

        self.root = put(self.root)

    def remove(self, key):
        def cut(n, key):
            if n.key == key:
                if n.left is None or n.right is None:
                    return n.left or n.right
                low = n.right
                while low.left:
                    low = low.left
                n.key, n.right = low.key, cut(n.right, low.key)
            elif key < n.key:
                n.left = cut(n.left, key)
            else:
                n.right = cut(n.right, key)
            return self._fix(n)

        self.root = cut(self.root, key)

    def tightest(self, size):
        """The smallest (remaining, bin) with remaining >= size, or None."""
        n, best = self.root, None
        while n:
            if n.key >= (size, -1):
                best, n = n.key, n.left
            else:
                n = n.right
        return best

    def roomiest(self):
        n = self.root
        while n.right:
            n = n.right
        return n.key


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]]:
    """Pack count groups of each size; (size, count, bin) runs, sizes descending.

    bins None: open a bin whenever none fits, which minimises shards. Else that many bins are there from the start, and
    a group that fits none goes to the bin with the most room.
    """
    tree, runs, opened = CapacityTree(), [], bins or 0
    for b in range(opened):
        tree.insert((capacity, b))
    for size, count in sorted(histogram, reverse=True):
        while count:
            got = tree.tightest(size)
            if got is None and (bins is None or tree.root is None):
                got = (max(capacity, size), opened)
                opened += 1
                tree.insert(got)
            put = min(count, got[0] // max(size, 1)) if got else 1
            got = got or tree.roomiest()
            tree.remove(got)
            tree.insert((got[0] - put * size, got[1]))
            runs.append((size, put, got[1]))
            count -= put
    return runs


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16, places: DataFrame | None = None, as_they_come: bool = False) -> DataFrame:
    """Every row gets a shard and a gapless slot in it; bytes per shard are near equal, equal texts stay together.

    A group of equal texts larger than a shard's share can't stay whole: it is dealt by the hash of the key into
    pieces of about half a share, packed like groups. At most `shards` groups are that large, so their list is short.
    A null text is empty and null keys are keys like others; repeated rows each get a slot (which of them gets which
    is not told apart). An empty table gives an empty result; a text larger than a share gets the roomiest shard.
    With places, the plan of mix_sources for docs, slots follow its positions within each shard; with as_they_come the order of docs itself, as
    its files hold it, so that what has been sorted stays so (rows that come from no file raise ValueError); else the hash of key and text.
    """
    spark = docs.sparkSession
    plain = F.coalesce(docs[text].cast("string"), F.lit(""))
    if as_they_come:
        if (docs := in_order(docs, "__part", "__row")) is None:
            raise ValueError("these rows come from no file and have no order")
    ordered_as = ["__part", "__row"] if as_they_come else []
    mixed_as = [docs["source"].cast("string").alias("__source"), mix_digest(docs[text]).alias("__mix_digest")] if places is not None else []
    rows = staged(
        docs.select(docs[key].cast("long").alias("doc_id"), (F.octet_length(plain).cast("long") + overhead).alias("size"), F.crc32(plain.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(plain, 256)).alias("__digest"), *mixed_as, *ordered_as),
        "shard-rows",
    )
    groups = rows.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__bytes"))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    capacity = max(1, -(-total // shards))
    huge = {bytes(r[0]): min(int(r[1]), -(-2 * int(r[2]) // capacity)) for r in groups.where((F.col("__bytes") > capacity) & (F.col("__n") > 1)).collect()}
    piece = F.lit(0)
    for digest, pieces in sorted(huge.items()):
        piece = F.when(F.col("__digest") == F.lit(digest), F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).cast("int")).otherwise(piece)
    rows = rows.withColumn("__piece", piece)
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), F.col("__bytes").cast("double")))) - (DIGITS - 1)).cast("long"))
    size_class = (F.ceil(F.col("__bytes") / step) * step).cast("long")
    pieces = staged(rows.groupBy("__digest", "__piece").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__n")).withColumn("__class", size_class), "shard-pieces")
    histogram = [(int(c), int(n)) for c, n in pieces.groupBy("__class").count().collect()]
    runs, ends = {}, {}
    for size, count, b in best_fit_decreasing(histogram, capacity, shards):
        ends[size] = ends.get(size, 0) + count
        runs.setdefault(size, []).append((ends[size], b))
    plan = spark.createDataFrame([(c, [e for e, _ in x], [b for _, b in x]) for c, x in sorted(runs.items())], "__plan_class long, __ends array<long>, __bins array<int>")
    placed = ranked(pieces, ["__class"], ["__digest", "__piece"], "__rank", sum(n for _, n in histogram))
    at = F.size(F.filter("__ends", lambda e: e <= F.col("__rank")))
    placed = placed.join(F.broadcast(plan), F.col("__class") == F.col("__plan_class")).select(F.col("__digest").alias("__d"), F.col("__piece").alias("__p"), F.get("__bins", at).alias("shard"))
    out = rows.join(placed, (F.col("__digest") == F.col("__d")) & (F.col("__piece") == F.col("__p")))
    out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "__digest", *(["__source", "__mix_digest"] if mixed_as else []), *ordered_as)
    if as_they_come:
        ahead = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        files = rows.groupBy(F.col("__part").alias("__of")).agg((F.max("__row") + 1).alias("__n")).select("__of", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
        out = out.join(F.broadcast(files), F.col("__part") == F.col("__of")).withColumn("__position", F.col("__ahead") + F.col("__row"))
        out = ranked(out, ["shard"], ["__position"], "slot", n_rows, place="__position")
    elif places is None:
        out = ranked(out, ["shard"], ["doc_id", "__digest"], "slot", n_rows)
    else:
        at = places.select(F.col("doc_id").alias("__m_id"), F.col("source").alias("__m_source"), F.col("__digest").alias("__m_digest"), F.col("position").alias("__position")).distinct()
        out = out.join(at, F.col("doc_id").eqNullSafe(F.col("__m_id")) & F.col("__source").eqNullSafe(F.col("__m_source")) & (F.col("__mix_digest") == F.col("__m_digest")))
        out = ranked(out, ["shard"], ["__position", "doc_id", "__digest"], "slot", n_rows, place="__position")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
