"""Derivation graphs: cheapest derivations, what a goal rests on, layers, and proofs with their trivial steps folded in.

A derivation is a row (step, head, premises, weight): all premises together give the head. Several steps may give one head, and cycles are allowed where
a function says so. Every function is a few joins and groups a round over exploded premises; no fact's derivations are gathered in Python.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.plans.staging import staged, unstaged


def _edges(steps: DataFrame) -> DataFrame:
    """(step, head, premise) for each distinct premise."""
    return steps.select("step", "head", F.explode(F.array_distinct("premises")).alias("premise")).where("premise is not null")


def least_weights(steps: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(fact, value, step): the least weight of each fact that can be derived, and a step that reaches it.

    A step costs its weight and the values of its distinct premises; a fact has the least cost of its steps, one without premises being given. A weight
    counts as 0 at least, and as 1 where there are premises, so no cycle is ever cheaper and following the steps told ends at given facts. Each
    round looks again only at steps with a premise that became cheaper. Of steps with the same cost the smallest is told.
    """
    n = F.size(F.filter(F.array_distinct(F.coalesce("premises", F.array())), lambda p: p.isNotNull()))
    weight = F.greatest(F.coalesce(F.col("weight").cast("long"), F.lit(0)), F.when(n > 0, 1).otherwise(0))
    sized = staged(steps.where("step is not null and head is not null").select("step", "head", weight.alias("weight"), n.alias("n")), "steps")
    uses = staged(_edges(steps), "uses")
    best = staged(sized.where("n = 0").groupBy(F.col("head").alias("fact")).agg(F.min("weight").alias("value")), "least")

    def costs(some: DataFrame) -> DataFrame:
        paid = some.join(best.select(F.col("fact").alias("premise"), "value"), "premise").groupBy("step").agg(F.count(F.lit(1)).alias("have"), F.sum("value").alias("paid"))
        return paid.join(sized, "step").where("have = n").select("step", F.col("head").alias("fact"), (F.col("weight") + F.col("paid")).alias("value"))

    delta = best
    for _ in range(most_rounds):
        again = uses.join(delta.select(F.col("fact").alias("premise")), "premise", "left_semi").select("step").distinct()
        heads = costs(uses.join(again, "step", "left_semi")).groupBy("fact").agg(F.min("value").alias("value"))
        known = best.select("fact", F.col("value").alias("before"))
        new = staged(heads.join(known, "fact", "left").where("before is null or value < before").select("fact", "value"), "least")
        if new.isEmpty():
            every = costs(uses).union(sized.where("n = 0").select("step", "head", "weight"))
            return every.join(best, ["fact", "value"], "left_semi").groupBy("fact", "value").agg(F.min("step").alias("step"))
        whole = staged(best.join(new, "fact", "left_anti").union(new), "least")
        if delta is not best:
            unstaged(delta)
        unstaged(best)
        best, delta = whole, new
    raise RuntimeError(f"weights did not settle in {most_rounds} rounds")


def explanation(steps: DataFrame, least: DataFrame, goals: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(goal, fact, step): every fact in the cheapest derivation of each goal, the goal itself included; goals has a column fact."""
    uses = staged(_edges(steps).join(least.select("step", F.col("fact").alias("head")), ["step", "head"], "left_semi"), "uses")
    start = goals.select(F.col("fact").alias("goal"), "fact").distinct().join(least, "fact", "left_semi").select("goal", "fact")
    reached = _reached(start, uses.select(F.col("head").alias("from"), F.col("premise").alias("to")), ["goal"], most_rounds)
    return reached.join(least.select("fact", "step"), "fact").select("goal", "fact", "step")


def _reached(start: DataFrame, moves: DataFrame, by: list[str], most_rounds: int) -> DataFrame:
    """(by..., fact): all that moves (from, to) lead to from the start, itself included; each round goes on from what is new."""
    delta = staged(start.distinct(), "reached")
    parts = []
    for _ in range(most_rounds):
        if delta.isEmpty():
            break
        parts.append(delta)
        known = start.sparkSession.read.schema(delta.schema).parquet(*(p._staged_at for p in parts))
        on = [c for c in moves.columns if c not in ("from", "to")]
        step = delta.withColumnRenamed("fact", "from").join(moves, [*on, "from"]).select(*by, F.col("to").alias("fact")).distinct()
        delta = staged(step.join(known, [*by, "fact"], "left_anti"), "reached")
    else:
        raise RuntimeError(f"reach did not settle in {most_rounds} rounds")
    return start.sparkSession.read.schema(delta.schema).parquet(*(p._staged_at for p in parts)) if parts else delta


#: Entries of a problem that a task holds while it searches it; larger problems are searched in rounds of joins.
MOST_ENTRIES = 1 << 20


def dependency_difference(steps: DataFrame, facts: DataFrame, points: DataFrame, goals: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(problem, fact, part): what each problem's goal rests on, as 'goal', 'proof', 'setup' or 'auxiliary'.

    steps: (problem, head, premises); facts: (problem, fact, args), the points that a fact names; points: (problem, point, rely_on); goals: (problem, fact). Facts that no
    step gives are premises: setup if all their points are in what the goal's points rely on, directly or not, else auxiliary. Cycles end; facts that no goal needs are left out.
    A problem's rows meet once and are searched where they meet. Problems of more than MOST_ENTRIES entries are searched together, facts and points in one pass, as nodes of
    one graph with two kinds.
    """
    names = "array<string>"
    rows = None
    for kind, df, name, list_ in ((0, steps, "head", "premises"), (1, facts, "fact", "args"), (2, points, "point", "rely_on"), (3, goals, "fact", None)):
        part = df.select("problem", F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), (F.coalesce(F.col(list_).cast(names), F.array().cast(names)) if list_ else F.array().cast(names)).alias("list"))
        rows = part if rows is None else rows.union(part)
    problem = goals.schema["problem"].dataType
    # dealt by a hash of the problem: Spark takes a union of tables that are dealt by problem for dealt already, and adaptive execution then joins its sides' partitions unevenly
    dealt = rows.withColumn("deal", F.xxhash64("problem")).repartition("deal").sortWithinPartitions("problem").drop("deal")
    told = dealt.mapInArrow(functools.partial(_searched, MOST_ENTRIES), f"problem {problem.simpleString()}, fact string, part string")
    told = staged(told, "told")
    large = told.where("part is null").select(F.col("problem").alias("large"))
    small = told.where("part is not null")
    if large.isEmpty():
        return small
    of_large = lambda df: df.join(F.broadcast(large), F.col("problem").eqNullSafe(F.col("large")), "left_semi")
    return small.union(_difference_in_rounds(of_large(steps), of_large(facts), of_large(points), of_large(goals), most_rounds))


def _searched(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(problem, fact, part) of rows (problem, kind, name, list) in order of problem; a problem that is null or too large has one row without a part."""
    now, held, size = None, [], 0
    out: tuple[list, list, list] = ([], [], [])

    def done() -> None:
        for fact, part in [(None, None)] if now is None or size > most else _parts(held):
            for column, value in zip(out, (now, fact, part), strict=True):
                column.append(value)

    def batch_of(problem: pa.DataType) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[0], problem), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["problem", "fact", "part"])
        for column in out:
            column.clear()
        return made

    first = True
    for batch in batches:
        kind_of = batch.column(0).type
        at, entries = batch.column(3).offsets.to_pylist(), batch.column(3).values.to_pylist()
        for problem, kind, name, lo, hi in zip(*(c.to_pylist() for c in batch.columns[:3]), at, at[1:], strict=False):
            if first or problem != now:
                if not first:
                    done()
                now, held, size, first = problem, [], 0, False
            size += 1 + hi - lo
            if size <= most:
                held.append((kind, name, entries[lo:hi]))
            else:
                held.clear()
        if len(out[0]) > 10_000:
            yield batch_of(kind_of)
    if not first:
        done()
        yield batch_of(kind_of)


def _parts(held: list[tuple]) -> list[tuple[str, str]]:
    """(fact, part) of one problem's rows (kind, name, list)."""
    steps, args, relies, goals = {}, {}, {}, set()
    for kind, name, list_ in held:
        if kind == 3:
            goals.add(name)
        else:
            (steps, args, relies)[kind].setdefault(name, []).extend(list_)
    goals.discard(None)

    def reached(start: set, moves: dict) -> set:
        seen, todo = set(start), list(start)
        while todo:
            new = [x for x in moves.get(todo.pop(), ()) if x not in seen]
            seen.update(new)
            todo += new
        return seen

    seen = reached({p for g in goals for p in args.get(g, ()) if p is not None}, relies)
    hidden = lambda fact: any(p is not None and p not in seen for p in args.get(fact, ()))
    part = lambda fact: "setup" if fact is None else "goal" if fact in goals else "proof" if fact in steps else "auxiliary" if hidden(fact) else "setup"
    return [(fact, part(fact)) for fact in reached(goals, steps)]


def _difference_in_rounds(steps: DataFrame, facts: DataFrame, points: DataFrame, goals: DataFrame, most_rounds: int) -> DataFrame:
    """dependency_difference, of problems of any size."""
    of = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name"))
    fact, point = of(0, "fact"), of(1, "point")
    down = steps.select("problem", F.col("head").alias("h"), F.explode("premises").alias("p")).select("problem", of(0, "h").alias("from"), of(0, "p").alias("to"))
    rely = points.select("problem", "point", F.explode("rely_on").alias("q")).select("problem", of(1, "point").alias("from"), of(1, "q").alias("to"))
    named = goals.join(facts, ["problem", "fact"]).select("problem", F.explode("args").alias("point"))
    start = goals.select("problem", fact.alias("fact")).union(named.select("problem", point.alias("fact")))
    reached = _reached(start.where("fact.name is not null"), staged(down.union(rely).distinct(), "moves"), ["problem"], most_rounds)
    seen = reached.where("fact.kind = 1").select("problem", F.col("fact.name").alias("point")).withColumn("visible", F.lit(True))
    needed = reached.where("fact.kind = 0").select("problem", F.col("fact.name").alias("fact"))
    heads = steps.select("problem", F.col("head").cast("string").alias("fact")).distinct().withColumn("derived", F.lit(True))
    args = facts.select("problem", F.col("fact").cast("string").alias("fact"), F.explode_outer(F.array_distinct("args")).alias("point")).withColumn("point", F.col("point").cast("string"))
    hidden = args.join(seen, ["problem", "point"], "left").groupBy("problem", "fact").agg(F.bool_or(F.col("point").isNotNull() & F.col("visible").isNull()).alias("hidden"))
    asked = goals.select("problem", F.col("fact").cast("string").alias("fact")).distinct().withColumn("asked", F.lit(True))
    out = needed.join(heads, ["problem", "fact"], "left").join(hidden, ["problem", "fact"], "left").join(asked, ["problem", "fact"], "left")
    part = F.when(F.col("asked"), "goal").when(F.col("derived"), "proof").when(F.col("hidden"), "auxiliary").otherwise("setup")
    return out.select("problem", "fact", part.alias("part"))


def layers(steps: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(problem, fact, layer): 0 for premises, else one more than the deepest premise, over all steps of a head; without cycles.

    A fact moves up only when one of its premises has moved up, so each round follows the facts that the last one moved.
    """
    moves = staged(steps.select("problem", F.col("head").alias("to"), F.explode("premises").alias("from")).where("`from` is not null").distinct(), "moves")
    every = moves.select("problem", F.col("from").alias("fact")).union(steps.select("problem", F.col("head").alias("fact"))).where("fact is not null").distinct()
    now = staged(every.withColumn("layer", F.lit(0)), "layers")
    delta = now
    for k in range(1, most_rounds):
        up = staged(delta.withColumnRenamed("fact", "from").join(moves, ["problem", "from"]).select("problem", F.col("to").alias("fact")).distinct().withColumn("layer", F.lit(k)), "layers")
        if up.isEmpty():
            return now
        new = staged(now.join(up, ["problem", "fact"], "left_anti").union(up), "layers")
        now, delta = new, up
    raise RuntimeError(f"layers did not settle in {most_rounds} rounds: the steps have a cycle")


def shortened(steps: DataFrame, keep_used: bool = True, most_rounds: int = 1000) -> DataFrame:
    """(problem, heads, premises): a proof with its trivial steps folded into those that use them, steps of equal premises made one.

    steps: (problem, head, premises, trivial, last), one step for each head and no cycles. A trivial step's head is replaced by its premises wherever it is
    used, through chains of them. With keep_used those that a step with a reason uses stay, as do the last steps. Arrays come sorted.
    """
    uses = staged(steps.select("problem", "head", "trivial", "last", F.explode_outer(F.array_distinct("premises")).alias("premise")), "uses")
    plain = steps.where("trivial and not last").select("problem", F.col("head").alias("premise"))
    if keep_used:
        plain = plain.join(uses.where("not trivial").select("problem", "premise").distinct(), ["problem", "premise"], "left_anti")
    plain = staged(plain.distinct().withColumn("folded", F.lit(True)), "folded")
    marked = staged(uses.join(plain, ["problem", "premise"], "left").join(plain.select("problem", F.col("premise").alias("head"), F.col("folded").alias("gone")), ["problem", "head"], "left"), "uses")
    inner = staged(marked.where("gone and premise is not null").select("problem", F.col("head").alias("from"), F.col("premise").alias("to")), "moves")
    start = marked.where("gone is null and folded").select("problem", "head", F.col("premise").alias("fact"))
    opened = _reached(start, inner, ["problem", "head"], most_rounds).join(plain.select("problem", F.col("premise").alias("fact")), ["problem", "fact"], "left_anti")
    flat = marked.where("gone is null and folded is null").select("problem", "head", F.col("premise").alias("fact")).union(opened.select("problem", "head", "fact"))
    flat = flat.union(marked.where("gone is null").select("problem", "head", F.lit(None).alias("fact")))
    one = flat.groupBy("problem", "head").agg(F.sort_array(F.collect_set("fact")).alias("premises"))
    return one.groupBy("problem", "premises").agg(F.sort_array(F.collect_list("head")).alias("heads")).select("problem", "heads", "premises")
