"""Near-duplicates at a word-shingle similarity: SimHash candidates, then an exact index for what they miss, each pair verified.

Close copies meet in the byte-position index of simhash.py, by fingerprints over the same shingles. At a Jaccard similarity of 0.8 a tenth to a
sixth of a fingerprint's bits differ, which 64 bits can't tell from strangers. So what the fingerprints miss comes from a prefix
index: two sets of that similarity share a shingle among the first few of each in any common order (prefix filter), so it misses no
pair; rare shingles come first in the order. Every candidate is verified on the whole sets of shingle hashes.

Pairs of one component need not all be verified. The leader of a posting is the member that has the fewest rarer shingles, so the one
nearest to what its members share; all are verified against it. Then every pair is verified that is left between different components and can
reach the similarity by the places of its shared shingles; where these are many, those outside a posting's largest component are
verified against the leader of that first, in rounds, as long as this links any. No posting is gathered anywhere. Sets are as large as the texts, so they are never all
stored: each pass makes them anew from the texts, and only those of candidates are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomill.operators.components import connected_components

from .common import NO_ID, arrow_batches, readable, staged, unstaged
from .simhash import bit_votes, links, majority
from .words import word_slices

#: A worker gets so many texts at once, and so many pairs of sets.
TEXTS, PAIRS = 1000, 256
#: Hash ranges whose counts order the shingles (a power of two), and how many of them are told in a row.
ORDER_BUCKETS, ORDER_PART = 1 << 18, 4096
#: Differing bits at which fingerprints link; candidates alone, as all are verified.
BITS = 2
#: Up to so many texts are named to all tasks (16 bytes each); beyond it texts and names are joined by a shuffle.
NAMED = 100_000
#: While what is left meets more often than so many times for each node, leaders are tried in a further round, up to so many rounds.
MEETINGS, ROUNDS = 4, 8


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """64-bit hashes of the word shingles of a whole text, in order; fewer words than a shingle (or none) are one."""
    found = [np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in part), np.uint64, len(part)) for part in word_slices((text or "").encode().lower())]
    h = np.concatenate([*found, np.zeros(0, np.uint64)])
    size = min(words, len(h))
    out = np.full(max(1, len(h) - words + 1), size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def node_of(members: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash of its sorted members."""
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), 2)).view(np.int64))


def least_overlap(a, b, similarity: float):
    """The number of shared members from which sets of sizes a and b reach the similarity (whole arithmetic of millionths)."""
    s = round(similarity * 1_000_000)
    return -(-s * (a + b) // (1_000_000 + s))


def prefix_length(size: int, similarity: float) -> int:
    s = round(similarity * 1_000_000)
    return size - -(-s * size // 1_000_000) + 1


def _range_of(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(64 - ORDER_BUCKETS.bit_length() + 1)).astype(np.int64)


def _marks(texts: DataFrame, words: int) -> DataFrame:
    """(id, text_hash, node, size, fp) of each text, and in rows of their own (part, counts): how many shingles fall into each hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("fp", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
        total = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            node, size, fp = [], [], []
            for t in batch.column(2).to_pylist():
                h = shingle_hashes(t, words)
                members = np.unique(h)
                node.append(node_of(members))
                size.append(len(members))
                fp.append(majority(bit_votes(h), len(h)))
                np.add.at(total, _range_of(members), 1)
            none = len(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], schema=schema)
        if total.any():
            parts = total.reshape(-1, ORDER_PART)
            none = len(parts)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(none, f.type) for f in list(schema)[:5]), pa.array(range(none), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)

    return texts.mapInArrow(run, "id long, text_hash long, node long, size int, fp long, part int, counts binary")


def _frequencies(marks: DataFrame) -> np.ndarray:
    """How many shingles fall into each of ORDER_BUCKETS hash ranges: common shingles stand out. It sets an order only."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [sum(np.frombuffer(c, np.int64) for c in pdf["counts"]).tobytes()]})

    out = np.zeros((ORDER_BUCKETS // ORDER_PART, ORDER_PART), np.int64)
    told = marks.where("part is not null").select("part", "counts").mapInArrow(in_task, "part int, counts binary")
    for r in told.groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        out[r.part] = np.frombuffer(bytes(r.counts), np.int64)
    return out.reshape(-1)


def _postings(texts: DataFrame, often: np.ndarray, similarity: float, words: int) -> DataFrame:
    """(shingle, node, size, at): each node under the first shingles of its set, rare ranges first, then by hash.

    A task tells each node once, so copies are thinned out before anything is sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            shingle, node, size, at = [], [], [], []
            for t in batch.column(0).to_pylist():
                h = np.unique(shingle_hashes(t, words))
                n = node_of(h)
                if n in told:
                    continue
                told.add(n)
                take = prefix_length(len(h), similarity)
                shingle.append(h[np.lexsort((h, often[_range_of(h)]))[:take]].view(np.int64))
                node.append(np.full(take, n, np.int64))
                size.append(np.full(take, len(h), np.int32))
                at.append(np.arange(take, dtype=np.int32))
            if shingle:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (shingle, node, size, at)], names=["shingle", "node", "size", "at"])

    return texts.select("text").mapInArrow(run, "shingle long, node long, size int, at int")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, set) of texts; a set is its sorted hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names=["node", "set"])

    return texts.select("text").mapInArrow(run, "node long, set binary")


def _named(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The texts that names (id, text_hash) tell."""
    wanted = names.select(F.col("id").alias("__i"), F.col("text_hash").alias("__h")).distinct()
    few = wanted.limit(NAMED + 1).count() <= NAMED
    return texts.join(F.broadcast(wanted) if few else wanted, (F.col("id") == F.col("__i")) & (F.col("text_hash") == F.col("__h")), "left_semi")


def _alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(a, b).cast("long") * 1_000_000 >= F.greatest(a, b).cast("long") * F.lit(round(similarity * 1_000_000))


def _reaches(overlap: Column, a: Column, b: Column, millionths: int) -> Column:
    """Whether this overlap suffices for sets of sizes a and b."""
    return overlap * (1_000_000 + millionths) >= (a + b) * F.lit(millionths)


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets have the Jaccard similarity; staged."""
    spark = pairs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                size = len(both)
                both.sort()
                ok.append(int((both[1:] == both[:-1]).sum()) >= least_overlap(size, 0, similarity))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    size_a, size_b = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}")) for c in "ab")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = staged(pairs.join(size_a, "a").join(size_b, "b").where(_alike(F.col("size_a"), F.col("size_b"), similarity)).select("a", "b"), "pairs")
    wanted = pairs.select("a").union(pairs.select("b")).distinct()
    names = nodes.join(wanted, F.col("node") == F.col("a"), "left_semi").select("least.id", "least.text_hash")
    with arrow_batches(spark, TEXTS):
        known = staged(_sets(_named(texts, names), words).dropDuplicates(["node"]), "sets")
    left = known.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = known.select(F.col("node").alias("b"), F.col("set").alias("y"))
    with arrow_batches(spark, PAIRS):
        out = staged(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    unstaged(pairs)
    unstaged(known)
    return out


def _close_copies(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash: nodes of one fingerprint, and of fingerprints that link in the byte-position index."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    same = nodes.join(first, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    met = links(first.select("fp"), BITS)
    a, b = (first.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab")
    return same.union(met.join(a, "a").join(b, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))


def similar_links(texts: DataFrame, nodes: DataFrame, often: np.ndarray, similarity: float, words: int) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all pairs at the similarity.

    At the first shingle that both of a pair have, what follows it bounds the overlap (positional filter). So a member is out of a posting
    where its place fails that for the posting's smallest set.
    """
    s, size = round(similarity * 1_000_000), F.col("size").cast("long")
    with arrow_batches(texts.sparkSession, TEXTS):
        posted = _postings(texts, often, similarity, words)
        shared = posted.groupBy("shingle").agg(F.min("node").alias("__low"), F.max("node").alias("__high"), F.min("size").cast("long").alias("small"))
        shared = staged(shared.where("__low < __high").select("shingle", "small"), "shared")
        met = posted.join(shared, "shingle").where(_reaches(size - F.col("at"), size, F.greatest("small", F.ceil(size * s / F.lit(1_000_000)).cast("long")), s))
        met = staged(met.drop("small").dropDuplicates(["shingle", "node"]), "met")
    unstaged(shared)
    leads = met.groupBy("shingle").agg(F.min(F.struct("at", "node")).alias("__lead"))
    led = met.join(leads, "shingle").where("node <> __lead.node").select(F.col("node").alias("a"), F.col("__lead.node").alias("b"))
    found = verified(_close_copies(nodes).union(led), nodes, texts, similarity, words)
    linear = MEETINGS * nodes.count()
    for turn in range(ROUNDS + 1):
        roots = staged(connected_components(found).select(F.col("node").alias("__n"), "root"), "roots")
        apart = staged(_apart(met, roots), "apart")
        if turn == ROUNDS or _left(apart, similarity).count() <= linear:
            break
        best = apart.groupBy("shingle").agg(F.min(F.struct(-F.col("members"), F.col("at"), F.col("node"), F.col("root"))).alias("__best"))
        led = apart.join(best, "shingle").where(F.col("root") != F.col("__best.root")).select(F.col("node").alias("a"), F.col("__best.node").alias("b"))
        more = verified(led, nodes, texts, similarity, words)
        if more.isEmpty():
            break
        found = more.union(roots.select(F.col("__n").alias("a"), F.col("root").alias("b")))
        unstaged(apart)
    rest = verified(_left(apart, similarity), nodes, texts, similarity, words)
    unstaged(met)
    unstaged(apart)
    return rest.union(roots.select(F.col("__n").alias("a"), F.col("root").alias("b")))


def _apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings that hold several components: (shingle, node, size, at, root, members of that component)."""
    named = met.join(roots, F.col("node") == F.col("__n"), "left").select("shingle", "node", "size", "at", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("shingle").agg(F.min("root").alias("__low"), F.max("root").alias("__high")).where("__low < __high").select("shingle")
    members = roots.groupBy(F.col("root").alias("__r")).agg((F.count(F.lit(1)) + 1).alias("members"))
    return named.join(mixed, "shingle", "left_semi").join(members, F.col("root") == F.col("__r"), "left").select("shingle", "node", "size", "at", "root", F.coalesce("members", F.lit(1)).alias("members"))


def _left(apart: DataFrame, similarity: float) -> DataFrame:
    """Every pair (a, b) of nodes in different components that can reach the similarity by the places of a shared shingle.

    One of the two is outside the posting's largest component, so members of that never meet each other.
    """
    s = round(similarity * 1_000_000)
    best = apart.groupBy("shingle").agg(F.min(F.struct(-F.col("members"), "root")).alias("__best"))
    told = apart.join(best, "shingle").select("shingle", "node", F.col("size").cast("long"), F.col("at").cast("long"), "root", (F.col("root") != F.col("__best.root")).alias("minor"))
    x, y = (told.select("shingle", *(F.col(c).alias(f"{c}{i}") for c in ("node", "size", "at", "root", "minor"))) for i in "12")
    once = ~F.col("minor2") | (F.col("node1") < F.col("node2"))
    can = _reaches(F.least(F.col("size1") - F.col("at1"), F.col("size2") - F.col("at2")), F.col("size1"), F.col("size2"), s)
    met = x.where("minor1").join(y, "shingle").where((F.col("root1") != F.col("root2")) & once & can)
    return met.select(F.col("node1").alias("a"), F.col("node2").alias("b"))


def _components(docs: DataFrame, key: str, text: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(marks, named): a mark for each row of docs; for each node the first row of its texts and of its component, as (id, text_hash).

    A node is named by its first row before components are sought, so the smallest name of a component is the answer.
    """
    texts = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(docs[text]).alias("text_hash"), readable(docs[text]).alias("text"))
    with arrow_batches(texts.sparkSession, TEXTS):
        marks = staged(_marks(texts, words), "marks")
    often = _frequencies(marks)
    marks = marks.where("node is not null").select("id", "text_hash", "node", "size", "fp")
    nodes = staged(marks.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("least"), F.min("size").alias("size"), F.min("fp").alias("fp")), "nodes")
    found = similar_links(texts, nodes, often, similarity, words)
    a, b = (nodes.select(F.col("node").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    roots = connected_components(found.join(a, "a").join(b, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))
    roots = roots.select(F.col("node").alias("__n"), F.col("root").alias("__root"))
    return marks, nodes.join(roots, F.col("least") == F.col("__n"), "left").select("node", "least", F.coalesce("__root", "least").alias("root"))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, component_id, first) for each row of docs; first: this row's key and text stand for its component.

    component_id is the smallest key that can be reached over pairs of at least the Jaccard similarity, all of them. Texts with
    equal sets of shingles are one node from the start. Texts of fewer words than a shingle are one shingle; null and empty texts
    are alike. A null key is larger than any other. Repeated rows are all `first` where one is. Empty tables give empty results.
    """
    marks, named = _components(docs, key, text, words, similarity)
    out = marks.select("id", "text_hash", F.col("node").alias("__node")).join(named, F.col("__node") == F.col("node"))
    is_first = (F.col("id") == F.col("root.id")) & (F.col("text_hash") == F.col("root.text_hash"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(known("id").alias("doc_id"), "text_hash", known("root.id").alias("component_id"), is_first.alias("first"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs, with all its columns, for each component of similar_documents; of rows repeated in full one stays.

    Nulls, short and empty texts and ties are as told there: of the rows without a key and text one stays, and of two rows with one key
    the one whose text has the smaller hash. Empty tables give empty results.
    """
    _, named = _components(docs, key, text, words, similarity)
    mark = named.where(F.col("least") == F.col("root")).select(F.col("root.id").alias("__first_id"), F.col("root.text_hash").alias("__first_hash"))
    same = (F.coalesce(docs[key].cast("long"), F.lit(NO_ID)) == mark["__first_id"]) & (F.xxhash64(docs[text]) == mark["__first_hash"])
    w = Window.partitionBy(mark["__first_id"], mark["__first_hash"]).orderBy(*(docs[c].cast("string") for c in docs.columns if c != text))
    turn = "__turn" + "_" * max(map(len, docs.columns))  # no column of docs has this name
    return docs.join(mark, same).select(*(docs[c] for c in docs.columns), F.row_number().over(w).alias(turn)).where(F.col(turn) == 1).drop(turn)
