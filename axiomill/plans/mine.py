"""Training rows from diagrams: sampled statements, goals that hold in their closure, and what each goal rests on."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomill.functions.keys import predicate_key
from axiomill.plans import prove
from axiomill.plans.staging import staged
from axiomill.sources.statements import Definition, statement

#: How a sampled statement starts, and how likely (of 100).
ROOTS = (("a b c = triangle a b c", 70), ("a b = segment a b", 30))
#: Constructions that a sample adds, with the number of points they take.
STEPS = (("midpoint", 2), ("on_line", 2), ("on_circle", 2), ("foot", 3), ("orthocenter", 3), ("incenter", 3), ("circle", 3), ("on_tline", 3), ("on_pline", 3))


def weighted_pick(u: float, weights: tuple[tuple[str, int], ...]) -> str:
    """The entry in whose part of the summed weights u (0 to 1) falls."""
    at, total = 0.0, sum(w for _, w in weights)
    for name, w in weights:
        at += w / total
        if u < at:
            return name
    return weights[-1][0]


def sampled_statement(seed: int, clauses: int = 3) -> str:
    """One statement without a goal; the same for the same seed."""
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}".encode(), digest_size=8).digest(), "big"))
    out = [weighted_pick(rng.random(), ROOTS)]
    points = out[0].split(" = ")[0].split()
    while len(out) <= clauses:
        name, size = STEPS[rng.integers(len(STEPS))]
        if size <= len(points):
            new = "abcdefghijklmnopqrstuvwxyz"[len(points)]
            out.append(f"{new} = {name} {new} {' '.join(rng.permutation(points)[:size])}")
            points.append(new)
    return "; ".join(out)


def sample_statements(spark: SparkSession, count: int, seed: int = 0, clauses: int = 3) -> DataFrame:
    """(problem_id, statement): count samples, made where they are needed."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"problem_id": [f"s{seed}-{i}" for i in pdf["id"]], "statement": [sampled_statement(seed * 1_000_003 + i, clauses) for i in pdf["id"]]})

    return spark.range(count).mapInPandas(run, "problem_id string, statement string").dropDuplicates(["statement"])


def candidate_goals(facts: DataFrame, points: DataFrame, per_family: int = 20, algebra: bool = True) -> DataFrame:
    """(problem_id, goal, family): what the class tables make true beyond the basic facts, at most per_family of a kind per statement.

    Kinds are every choice of three points of a line, of four of a circle, of equal, parallel and perpendicular segments, of midpoints, of equal
    angles and ratios (but for those whose sides are the same directions or lengths), and the facts that rules found. Members of one class are
    found by equi-joins on the class; ranks by hash choose among all of a kind.
    """
    tables = prove.class_tables(facts, points, algebra)
    every_pair = tables["pair"].select("problem_id", "a", "b", "line", "dir", "len")
    pair = every_pair.where("a < b")
    x, y = (pair.select("problem_id", *(F.col(c).alias(f"{c}{i}") for c in ("a", "b", "line", "dir", "len"))) for i in "12")
    four = F.array("a1", "b1", "a2", "b2")
    first = F.struct("a1", "b1") < F.struct("a2", "b2")
    made = lambda df, name, args: df.select("problem_id", F.lit(name).alias("family"), args.alias("args"))
    cong = x.join(y, (x["problem_id"] == y["problem_id"]) & (F.col("len1") == F.col("len2"))).drop(y["problem_id"]).where(first)
    para = x.join(y, (x["problem_id"] == y["problem_id"]) & (F.col("dir1") == F.col("dir2"))).drop(y["problem_id"]).where(first & (F.col("line1") != F.col("line2")))
    square = tables["perp"].select(F.col("problem_id").alias("pid"), "d1", "d2").where("d1 < d2")
    perp = x.join(square, (F.col("problem_id") == F.col("pid")) & (F.col("dir1") == F.col("d1"))).drop("pid").join(y.withColumnRenamed("problem_id", "pid"), (F.col("problem_id") == F.col("pid")) & (F.col("d2") == F.col("dir2"))).drop("pid")

    m = every_pair.withColumnsRenamed({"a": "m", "b": "p"})
    midp = made(m.join(m.withColumnRenamed("p", "q"), ["problem_id", "m", "line", "len"]).where("p < q"), "midp", F.array("m", "p", "q"))
    line = pair.select("problem_id", "line", F.explode(F.array("a", "b")).alias("p")).distinct()
    coll = made(_choices(line, "line", 3), "coll", F.col("chosen"))
    round_ = made(_choices(tables["circ"].select("problem_id", "circle", "p").distinct(), "circle", 4), "cyclic", F.col("chosen"))
    eqangle = _equal_values(pair, "dir", tables["ang"].select("problem_id", F.col("d1").alias("k1"), F.col("d2").alias("k2"), "v"), "eqangle")
    eqratio = _equal_values(pair, "len", tables["rat"].select("problem_id", F.col("l1").alias("k1"), F.col("l2").alias("k2"), "v"), "eqratio")
    derived = facts.where("level > 0").select("problem_id", F.col("name").alias("family"), "args")

    every = made(cong, "cong", four).union(made(para, "para", four)).union(made(perp, "perp", four))
    for more in (coll, round_, midp, eqangle, eqratio, derived):
        every = every.union(more)
    keyed = every.select("problem_id", "family", predicate_key(F.col("family"), F.col("args")).alias("goal")).distinct()
    new = keyed.join(facts.where("level = 0").select("problem_id", F.col("key").alias("goal")), ["problem_id", "goal"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("problem_id", "family").orderBy(F.sha2("goal", 256), "goal"))
    return new.withColumn("__rank", rank).where(F.col("__rank") <= per_family).drop("__rank")


def _choices(members: DataFrame, key: str, size: int) -> DataFrame:
    """(problem_id, key, chosen): every choice of `size` points p of a line or circle, in order of name."""
    out = members.select("problem_id", key, F.col("p").alias("__last"), F.array("p").alias("chosen"))
    for _ in range(size - 1):
        grown = out.join(members, ["problem_id", key]).where(F.col("p") > F.col("__last"))
        out = grown.select("problem_id", key, F.col("p").alias("__last"), F.concat("chosen", F.array("p")).alias("chosen"))
    return out.drop("__last")


def _equal_values(pair: DataFrame, by: str, values: DataFrame, name: str) -> DataFrame:
    """(problem_id, family, args): two segments whose angle or ratio (by class `by`) is that of two others, in every spelling by points."""
    end = lambda i: pair.select("problem_id", F.col("a").alias(f"a{i}"), F.col("b").alias(f"b{i}"), F.col(by).alias(f"k{i}"))
    two = values.where("k1 <> k2").join(end(1), ["problem_id", "k1"]).join(end(2), ["problem_id", "k2"])
    left = two.select("problem_id", "v", "k1", "k2", F.array("a1", "b1", "a2", "b2").alias("one"))
    right = two.select("problem_id", "v", F.col("k1").alias("k3"), F.col("k2").alias("k4"), F.array("a1", "b1", "a2", "b2").alias("two"))
    same = left.join(right, ["problem_id", "v"]).where((F.col("one") < F.col("two")) & ((F.col("k1") != F.col("k3")) | (F.col("k2") != F.col("k4"))))
    return same.select("problem_id", F.lit(name).alias("family"), F.concat("one", "two").alias("args"))


def orphan_count(goal: str, text: str, defs: dict[str, Definition]) -> int:
    """Points of the statement that the goal does not rest on."""
    points = {p for c in statement(text).clauses for p in c.points}
    return len(points - prove.relied_on(f"{text.partition('?')[0].strip()} ? {goal}", defs))


def mine(spark: SparkSession, statements: DataFrame, defs: dict[str, Definition] | None = None, rules=None, most_levels: int = 3, least_steps: int = 2, per_family: int = 5) -> DataFrame:
    """(problem_id, full_problem, visible_problem, target_auxiliary, goal, num_proof_steps, aux_step_fraction): goals whose proof needs points that they do not rest on.

    visible_problem has the clauses that the goal's own points rest on; target_auxiliary the others that the proof uses.
    """
    defs = defs or prove.own_definitions()
    facts, points = prove.build(spark, statements, defs)
    facts, points = staged(facts, "facts"), staged(points, "points")
    closed, _ = prove.deduce(facts, points, rules, most_levels=most_levels)
    goals = staged(candidate_goals(closed, points, per_family), "goals")
    columns = "problem_id string, full_problem string, visible_problem string, target_auxiliary string, goal string, num_proof_steps int, aux_step_fraction double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text, out = pdf["statement"].iloc[0], []
        rows = pdf.drop_duplicates("key")[["key", "name", "args", "level", "rule", "why", "clause"]].to_dict("records")
        for r in rows:
            r["rule"] = r["rule"] if isinstance(r["rule"], str) else None
            r["why"] = list(r["why"]) if r["why"] is not None else []
        xy, s = prove._xy(pdf["diagram"].iloc[0]), statement(text)
        for goal in pdf["goals"].iloc[0]:
            steps = prove.explain_goal(rows, xy, goal)
            if steps is None:
                continue
            own = prove.relied_on(f"{text} ? {goal}", defs)
            used = {int(x["clause"]) for x in steps if x["rule"] is None}
            seen = [c for c in s.clauses if set(c.points) <= own]
            extra = [c for i, c in enumerate(s.clauses) if i in used and not set(c.points) <= own]
            derived = [x for x in steps if x["rule"]]
            hidden = {p for c in extra for p in c.points}
            if len(derived) >= least_steps and extra:
                share = sum(bool(hidden & set(x["fact"].split(" ")[1:])) for x in derived) / len(derived)
                out.append((pdf["problem_id"].iloc[0], f"{text} ? {goal}", "; ".join(c.text() for c in seen) + f" ? {goal}", "; ".join(c.text() for c in extra), goal, len(derived), round(share, 3)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")])

    asked = goals.groupBy("problem_id").agg(F.array_sort(F.collect_list("goal")).alias("goals"))
    rows = prove._with_points(closed, points).join(statements.select("problem_id", "statement"), "problem_id").join(asked, "problem_id")
    return rows.groupBy("problem_id").applyInPandas(run, columns)


def counterfactuals(spark: SparkSession, statements: DataFrame, defs: dict[str, Definition] | None = None, rules=None, most_levels: int = 3) -> DataFrame:
    """(problem_id, goal): facts about a statement's own points that hold with its last clause and not without it."""
    defs = defs or prove.own_definitions()
    text = F.trim(F.substring_index("statement", "?", 1))
    parts = F.split(text, r";\s*")
    without = statements.select(F.concat("problem_id", F.lit("|v")).alias("problem_id"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "; ").alias("statement"))
    whole = statements.select(F.concat("problem_id", F.lit("|r")).alias("problem_id"), text.alias("statement"))
    facts, points = prove.build(spark, whole.unionByName(without), defs)
    facts, points = staged(facts, "facts"), staged(points, "points")
    closed, _ = prove.deduce(facts, points, rules, most_levels=most_levels)
    goals = staged(candidate_goals(closed, points, 200).withColumn("part", F.substring_index("problem_id", "|", -1)).withColumn("problem_id", F.substring_index("problem_id", "|", 1)), "goals")
    base = facts.withColumn("part", F.substring_index("problem_id", "|", -1)).where("part = 'v'").select(F.substring_index("problem_id", "|", 1).alias("problem_id"), F.col("key").alias("goal"))
    old = points.where("problem_id like '%|v'").groupBy(F.substring_index("problem_id", "|", 1).alias("problem_id")).agg(F.collect_set("p").alias("ps"))
    known = goals.where("part = 'v'").select("problem_id", "goal").union(base)
    more = goals.where("part = 'r'").join(known, ["problem_id", "goal"], "left_anti").join(old, "problem_id")
    args = F.split("goal", " ")
    return more.where(F.size(F.array_except(F.slice(args, 2, F.size(args) - 1), F.col("ps"))) == 0).select("problem_id", "goal")


def placements(clause_text: str, points: list[str], seed: int, maximum: int) -> list[str]:
    """The clause, then the same construction over other points: seeded order, distinct points, each placement once.

    A smaller maximum gives a prefix of what a larger one gives.
    """
    from itertools import permutations

    from axiomill.sources.statements import clause

    c = clause(clause_text)
    out = {c.text(): None}
    if maximum > 1 and len(c.constructions) == 1:
        name, args = c.constructions[0]
        own = [a for a in args if a in c.points]
        inputs = [a for a in args if a not in c.points]
        order = sorted(dict.fromkeys(points), key=lambda p: hashlib.blake2b(f"{seed}:{p}".encode(), digest_size=8).digest())
        for chosen in permutations(order, len(inputs)):
            if len(out) >= maximum:
                break
            out[f"{' '.join(c.points)} = {' '.join([name, *own, *chosen])}"] = None
    return list(out)[: max(1, maximum)]


def bridge_scores(facts: DataFrame, points: DataFrame, old: DataFrame, algebra: bool = True) -> DataFrame:
    """(problem_id, score): how many old objects the new points of a statement meet. old: (problem_id, ps) with the old points.

    A line or circle through a new point and n old ones counts 1 + min(2, n); a direction or length that a new object shares with
    old points counts 2; each meeting beyond the first counts 1 more.
    """
    tables = prove.class_tables(facts, points, algebra)
    known = old.select("problem_id", F.explode("ps").alias("p"), F.lit(True).alias("is_old"))
    mark = lambda df, c: df.join(known.withColumnRenamed("p", c).withColumnRenamed("is_old", f"old_{c}"), ["problem_id", c], "left").withColumn(f"old_{c}", F.coalesce(f"old_{c}", F.lit(False)))
    pair = mark(mark(tables["pair"].select("problem_id", "a", "b", "line", "dir", "len"), "a"), "b")
    circ = mark(tables["circ"], "p")

    def through(df: DataFrame, kind: str, obj: str, point: str) -> DataFrame:
        got = df.groupBy("problem_id", obj).agg(F.array_sort(F.collect_set(F.when(F.col(f"old_{point}"), F.col(point)))).alias("ps"), F.max(~F.col(f"old_{point}")).alias("has_new"))
        return got.where("has_new and size(ps) > 0").select("problem_id", F.lit(kind).alias("kind"), "ps").distinct()

    ends = pair.select("problem_id", "line", "dir", "len", F.col("a").alias("p"), F.col("old_a").alias("old_p"))
    channels = through(ends, "line", "line", "p").union(through(circ, "circle", "circle", "p"))
    values = through(ends, "direction", "dir", "p").union(through(ends, "length", "len", "p"))
    c = channels.groupBy("problem_id").agg(F.sum(1 + F.least(F.lit(2), F.size("ps"))).alias("sum"), F.count(F.lit(1)).alias("n"))
    v = values.groupBy("problem_id").agg(F.count(F.lit(1)).alias("m"))
    both = facts.select("problem_id").distinct().join(c, "problem_id", "left").join(v, "problem_id", "left").na.fill(0)
    return both.select("problem_id", (F.col("sum") + 2 * F.col("m") + F.greatest(F.lit(0), F.col("n") + F.col("m") - 1)).cast("long").alias("score"))


def ranked_proposals(scored: DataFrame, maximum: int = 0) -> DataFrame:
    """(group, text, index, score) by falling score, then text, then index; the first `maximum` of each group (0: all)."""
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "text", "index"))
    out = scored.withColumn("place", place)
    return out.where(F.col("place") <= maximum) if maximum > 0 else out
