"""Equivalence classes and closures of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.operators.fixpoint import closure
from axiomill.plans.staging import staged, unstaged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
    far = both.where("b > a")
    return far.join(least, far["a"] == least["k"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    moved = down.join(least, down["a"] == least["k"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def _told(df: DataFrame):
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link to another; the root is the component's smallest node.

    edges has columns a and b of one orderable type, in any direction, repeats allowed; nulls and self-links are ignored.
    Large-star and small-star steps alternate. Each is a grouped minimum, combined on the map side, and an equi-join: no node's
    neighbours are gathered anywhere, so a hub is spread like any hot join key. Rounds grow with the logarithm of a component's width.
    """
    now = staged(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    told = None
    for _ in range(most_rounds):
        new = staged(_small_star(_large_star(now)), "links")
        unstaged(now)
        now, before = new, told
        told = _told(now)
        if told == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def transitive_closure(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """All (a, b) with a path from a to b; cycles allowed. See fixpoint.closure."""
    return closure(edges, most_rounds=most_rounds).pairs


def remove_descendants(clauses: DataFrame, removed: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Clauses (clause, points, args) left once the removed ones and all that build on their points are gone, directly or not."""
    gone = staged(clauses.join(removed.select("clause").distinct(), "clause", "left_semi").select("clause"), "gone")
    size = gone.count()
    points = clauses.select("clause", F.explode("points").alias("point"))
    uses = clauses.select("clause", F.explode("args").alias("point"))
    for _ in range(most_rounds):
        lost = points.join(gone, "clause", "left_semi").select("point").distinct()
        new = staged(gone.union(uses.join(lost, "point", "left_semi").select("clause")).distinct(), "gone")
        unstaged(gone)
        gone, before = new, size
        size = gone.count()
        if size == before:
            return clauses.join(gone, "clause", "left_anti")
    raise RuntimeError(f"descendants did not settle in {most_rounds} rounds")
