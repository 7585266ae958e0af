"""Classes of nodes merged by dated links: which class holds a node up to a level, and by which links two nodes came together.

A minimum spanning forest by level answers for every level at once: the links of a level or below join the same nodes in the forest as in the whole table, so
everything after the forest works on less than one link per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.operators.components import connected_components
from axiomill.plans.staging import staged, unstaged


def _undirected(links: DataFrame) -> DataFrame:
    both = links.where("a is not null and b is not null and level is not null and a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "level").groupBy("a", "b").agg(F.min("level").alias("level"))


def merge_forest(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(a, b, level): a spanning forest of least levels; among equal levels the smaller (a, b) is taken first. a < b.

    links has a, b and level; repeats count with their lowest level, self-links and nulls are ignored. In a round every component takes its lowest link to
    another one (a minimum on the map side), components that are linked become one, and of parallel links the lowest stays. So the links shrink
    and the components at least halve each round.
    """
    spark = links.sparkSession
    left = staged(_undirected(links).select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("level", "a", "b").alias("link")), "merge-links")
    schema = links.select("a", "b", "level").schema
    taken: list[DataFrame] = []
    for _ in range(most_rounds):
        if left.isEmpty():
            unstaged(left)
            if not taken:
                return spark.createDataFrame([], schema)
            return spark.read.schema(taken[0].schema).parquet(*(t._staged_at for t in taken)).select("link.a", "link.b", "link.level")
        ends = left.select("x", F.struct("link", F.col("y").alias("to")).alias("best")).union(left.select("y", F.struct("link", F.col("x").alias("to"))))
        lowest = ends.groupBy("x").agg(F.min("best").alias("best"))
        chosen = staged(lowest.select(F.least("x", "best.to").alias("x"), F.greatest("x", "best.to").alias("y"), "best.link").distinct(), "merge-forest")
        roots = connected_components(chosen.select(F.col("x").alias("a"), F.col("y").alias("b")))
        moved = left
        for side in ("x", "y"):
            moved = moved.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left").withColumn(side, F.coalesce(f"{side}_root", side)).drop(f"{side}_root")
        moved = moved.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("link").alias("link"))
        new = staged(moved, "merge-links")
        unstaged(left)
        left = new
        taken.append(chosen)
    raise RuntimeError(f"forest did not settle in {most_rounds} rounds")


def classes_upto(forest: DataFrame, levels: list) -> DataFrame:
    """(upto, node, root) for each level given: the classes that the links below it make; the root is the smallest node, which has no row itself, nor have lone nodes.

    forest: what merge_forest returns, or the links themselves, which is less work where few levels are asked. Levels are taken in order, and each one only joins the classes of the one before.
    """
    spark = forest.sparkSession
    node = forest.schema["a"].dataType
    known, out, low = None, [], None
    for upto in sorted(set(levels)):
        fresh = forest.where((F.col("level") < F.lit(upto)) & (F.col("level") >= F.lit(low) if low is not None else F.lit(True)))
        low = upto
        if known is None:
            now = connected_components(fresh)
        else:
            at = fresh.select("a", "b")
            for side in ("a", "b"):
                at = at.join(known.select(F.col("node").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
            joined = connected_components(at.where("a <> b"))
            first = known.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            now = first.union(joined.join(known, "node", "left_anti").select("node", "root"))
        known = staged(now, "classes")
        out.append(known.select(F.lit(upto).alias("upto"), "node", "root"))
    if not out:
        return forest.select(F.col("level").alias("upto"), F.col("a").cast(node).alias("node"), F.col("a").alias("root")).limit(0)
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole


def merge_paths(links: DataFrame, asked: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(ask, step, a, b, level): for each row (ask, x, y, upto) of asked a shortest path of links below upto from y back to x, as links a - b.

    Searches of all rows run together, breadth first: a node is reached in the round of its distance, from the smallest node that reaches it. A search ends
    when it has found y or has no new nodes; rows without a path, with x = y or with nulls have no steps. A link counts with its lowest level.
    """
    low = staged(_undirected(links), "merge-links")
    both = staged(low.select(F.col("a").alias("at"), F.col("b").alias("to"), "level").union(low.select("b", "a", "level")), "merge-links")
    want = staged(asked.select("ask", "x", "y", "upto").where("ask is not null and x is not null and y is not null and upto is not null and x <> y").distinct(), "merge-asked")
    front = staged(want.select("ask", F.col("x").alias("node"), F.col("x").cast(links.schema["a"].dataType).alias("parent"), F.lit(None).cast(links.schema["level"].dataType).alias("level")), "merge-front")
    seen = [front]
    read = lambda: want.sparkSession.read.schema(front.schema).parquet(*(s._staged_at for s in seen))
    for _ in range(most_rounds):
        open_ = want.join(read().select("ask", F.col("node").alias("y")), ["ask", "y"], "left_anti")
        reached = seen[-1].join(open_.select("ask", "upto"), "ask").join(both.withColumnRenamed("level", "by"), F.col("node") == F.col("at")).where("by < upto")
        best = reached.groupBy("ask", F.col("to").alias("node")).agg(F.min(F.struct(F.col("at").alias("parent"), F.col("by").alias("level"))).alias("p"))
        new = staged(best.select("ask", "node", "p.parent", "p.level").join(read(), ["ask", "node"], "left_anti"), "merge-front")
        if new.isEmpty():
            break
        seen.append(new)
    else:
        raise RuntimeError(f"paths did not settle in {most_rounds} rounds")
    way = want.select("ask", F.col("y").alias("node"))
    steps, tree = [], read().where("level is not null")
    for k in range(len(seen) - 1):
        step = staged(way.join(tree, ["ask", "node"]).select("ask", F.lit(k).alias("step"), F.col("node").alias("a"), F.col("parent").alias("b"), "level"), "merge-steps")
        if step.isEmpty():
            break
        steps.append(step)
        way = step.select("ask", F.col("b").alias("node"))
    if not steps:
        return tree.select("ask", F.lit(0).alias("step"), F.col("node").alias("a"), F.col("parent").alias("b"), "level").limit(0)
    return want.sparkSession.read.schema(steps[0].schema).parquet(*(s._staged_at for s in steps))
