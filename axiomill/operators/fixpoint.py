"""Closures that grow by their newest pairs alone, take in new links and give up old ones without starting anew.

A closure is kept as the tables of its rounds. A round joins the pairs of the last one with all that is known, drops what is known, and writes
only what is new: no round reads back or rewrites what the rounds before it have settled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill.plans.staging import staged


@dataclass
class Closure:
    """All pairs (a, b) with a path of links from a to b, as the tables of its rounds; told: (round, derived, new) of each round, its derivations of new pairs and these pairs."""

    spark: SparkSession
    schema: object
    parts: list[DataFrame] = field(default_factory=list)
    told: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def pairs(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(p._staged_at for p in self.parts))

    @property
    def rounds(self) -> DataFrame:
        return self.spark.createDataFrame(self.told, "round int, derived long, new long")


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").where("a is not null and b is not null").distinct()


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of every (a, v) on the left and (v, b) on the right."""
    return left.select("a", F.col("b").alias("v")).join(right.select(F.col("a").alias("v"), "b"), "v").select("a", "b")


def _grow(known: Closure, delta: DataFrame, edges: DataFrame | None, within: DataFrame | None, most_rounds: int) -> Closure:
    """Add delta, pairs that known lacks, and all that follows from it; within: nothing beyond these pairs is wanted."""
    for k in range(len(known.told), len(known.told) + most_rounds):
        ways = F.sum("ways") if "ways" in delta.columns else F.count(F.lit(1))
        derived, new = delta.agg(F.coalesce(ways, F.lit(0)), F.count(F.lit(1))).first()
        known.told.append((k, derived, new))
        if not new:
            return known
        old = known.pairs
        known.parts.append(delta)
        delta = delta.select("a", "b")
        if edges is not None:
            made = _joined(delta, edges)
        else:
            made = _joined(delta, known.pairs).union(_joined(old, delta))
        if within is not None:
            made = made.join(within, ["a", "b"], "left_semi")
        fresh = made.groupBy("a", "b").agg(F.count(F.lit(1)).alias("ways")).join(known.pairs, ["a", "b"], "left_anti")
        delta = staged(fresh, "closure")
    raise RuntimeError(f"closure did not settle in {most_rounds} rounds")


def _doubled(known: Closure, links: DataFrame, most_rounds: int) -> Closure:
    """All that follows from the links, with the length n of each pair's shortest path. After round k all paths of 2 ** k links or less are known, and a longer one begins with one
    of exactly that length: only these are joined, on one side, with all pairs."""
    delta = staged(links.select("a", "b", F.lit(1).alias("n"), F.lit(1).cast("long").alias("ways")), "closure")
    lengths = delta.select("a", "b", "n").schema
    for k in range(most_rounds):
        derived, new = delta.agg(F.coalesce(F.sum("ways"), F.lit(0)), F.count(F.lit(1))).first()
        known.told.append((k, derived, new))
        if not new:
            return known
        known.parts.append(delta)
        every = known.spark.read.schema(lengths).parquet(*(p._staged_at for p in known.parts))
        front = delta.where(F.col("n") == 1 << k).select("a", F.col("b").alias("v"))
        made = front.join(every.select(F.col("a").alias("v"), "b", (F.col("n") + (1 << k)).alias("n")), "v")
        fresh = made.groupBy("a", "b").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("ways"))
        delta = staged(fresh.join(known.pairs, ["a", "b"], "left_anti").select("a", "b", "n", "ways"), "closure")
    raise RuntimeError(f"closure did not settle in {most_rounds} rounds")


def closure(edges: DataFrame, linear: bool = False, most_rounds: int = 60) -> Closure:
    """The closure of links (a, b); cycles and repeats are allowed, nulls are ignored.

    The longest of the newest pairs are joined with all pairs, so rounds grow with the logarithm of the longest path. With linear the newest pairs are joined with the links alone:
    as many rounds as the longest path has links, and each pair is derived once for each last link. Every derivation of a round holds a pair of the round before.
    """
    links = _links(edges)
    if not linear:
        return _doubled(Closure(edges.sparkSession, links.schema), links, min(most_rounds, 30))
    links = staged(links, "links")
    return _grow(Closure(edges.sparkSession, links.schema), links, links, None, most_rounds)


def extended(known: Closure, added: DataFrame, most_rounds: int = 60) -> Closure:
    """The closure once the links of added have come too; work grows with the pairs that they bring. known stays as it is."""
    now = Closure(known.spark, known.schema, list(known.parts), list(known.told))
    delta = staged(_links(added).join(known.pairs, ["a", "b"], "left_anti"), "closure")
    return _grow(now, delta, None, None, most_rounds)


def retracted(known: Closure, edges: DataFrame, removed: DataFrame, most_rounds: int = 60) -> Closure:
    """The closure once the links of removed are gone; edges: the links that known was made from. known stays as it is.

    First every pair with a path over a removed link goes. Of these come back those that a remaining link, or one followed by an untouched pair, still gives, and what
    follows from them; nothing else is derived anew.
    """
    gone = staged(_links(removed).join(_links(edges), ["a", "b"], "left_semi"), "links")
    left = staged(_links(edges).join(gone, ["a", "b"], "left_anti"), "links")
    pairs = known.pairs
    upto = gone.union(_joined(pairs, gone))
    over = staged(upto.union(_joined(upto, pairs)).distinct(), "closure")
    kept = staged(pairs.join(over, ["a", "b"], "left_anti"), "closure")
    now = Closure(known.spark, known.schema, [kept])
    again = left.join(over, ["a", "b"], "left_semi")
    first = over.join(left.select("a", F.col("b").alias("v")), "a").join(kept.select(F.col("a").alias("v"), "b"), ["v", "b"], "left_semi").select("a", "b")
    return _grow(now, staged(again.union(first).distinct(), "closure"), None, over, most_rounds)
