"""Proofs: level by level, all statements at once, until nothing new follows.

facts(problem_id, key, name, args, level, rule, why, clause) and points(problem_id, p, xy) hold the state. In each level one grouped pass per
statement turns its facts into class tables (exact arithmetic needs Python), the rules run as joins over the tables
of all statements together, and a second grouped pass keeps of the conclusions those that do not follow from the
classes already. Groups are single statements, whose size does not grow with the number of statements. Every level is written to the shared folder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill.functions.keys import predicate_key
from axiomill.functions.realise import base_facts, instance, realise
from axiomill.operators.algebra import Classes
from axiomill.plans.rules import BY_ALGEBRA, match, standard_rules
from axiomill.plans.staging import staged, unstaged
from axiomill.sources.statements import Definition, Rule, definitions, statement

FACTS = "problem_id string, key string, name string, args array<string>, level int, rule string, why array<string>, clause int"
POINTS = "problem_id string, p string, xy struct<x:double,y:double>"
TABLES = "problem_id string, kind string, c1 string, c2 string, c3 string, c4 string, c5 string"

#: Definitions of constructions that the inline statements use; a file in this form gives others.
DEFINITIONS = """
angle_bisector x a b c
x : a b c x
a b c = ncoll a b c
x : eqangle b a b x b x b c
bisect a b c

circle x a b c
x : a b c
a b c = ncoll a b c
x : cong x a x b, cong x b x c
bline a b, bline a c

foot x a b c
x : a b c
a b c = ncoll a b c
x : perp x a b c, coll x b c
tline a b c, line b c

incenter x a b c
x : a b c
a b c = ncoll a b c
x : eqangle a b a x a x a c, eqangle c a c x c x c b; eqangle b c b x b x b a
bisect a b c, bisect b c a

excenter x a b c
x : a b c
a b c = ncoll a b c
x : eqangle a b a x a x a c, eqangle c a c x c x c b; eqangle b c b x b x b a
bisect b a c, exbisect b c a

intersection_ll x a b c d
x : a b c d
a b c d = npara a b c d, ncoll a b c d
x : coll x a b, coll x c d
line a b, line c d

midpoint x a b
x : a b
a b = diff a b
x : coll x a b, cong x a x b
midp a b

on_circle x o a
x : x o a
o a = diff o a
x : cong o x o a
circle o o a

on_line x a b
x : x a b
a b = diff a b
x : coll x a b
line a b

on_pline x a b c
x : x a b c
a b c = diff b c, ncoll a b c
x : para x a b c
pline a b c

on_tline x a b c
x : x a b c
a b c = diff b c
x : perp x a b c
tline a b c

orthocenter x a b c
x : a b c
a b c = ncoll a b c
x : perp x a b c, perp x b c a; perp x c a b
tline a b c, tline b c a

segment a b

 =
a : ; b :
segment

triangle a b c

 =
a : ; b : ; c :
triangle
"""


def own_definitions() -> dict[str, Definition]:
    return definitions(DEFINITIONS)


def build(spark: SparkSession, statements: DataFrame, defs: dict[str, Definition], seed: str = "") -> tuple[DataFrame, DataFrame]:
    """(facts, points) of statements (problem_id, statement): basic facts at level 0, and a diagram in which the goal holds.

    A statement that can't be read or drawn has no rows in either. A column `seed` draws each statement's diagram by its own.
    """

    def made(text: str, seed: str):
        try:
            s = statement(text)
            xy = realise(s, defs, seed)
            return (base_facts(s, defs), xy) if xy else None
        except (ValueError, KeyError, IndexError):
            return None

    def run(batches):
        for batch in batches:
            rows = []
            for pid, text, own in zip(batch["problem_id"], batch["statement"], batch["seed"], strict=True):
                got = made(text, own)
                if got:
                    rows += [(pid, "fact", n, list(a), c, None, None) for n, a, c in got[0]]
                    rows += [(pid, "point", p, None, None, x, y) for p, (x, y) in got[1].items()]
            yield pd.DataFrame(rows, columns=["problem_id", "kind", "name", "args", "clause", "x", "y"])

    own = F.coalesce("seed", F.lit(seed)) if "seed" in statements.columns else F.lit(seed)
    both = staged(statements.select("problem_id", "statement", own.alias("seed")).mapInPandas(run, "problem_id string, kind string, name string, args array<string>, clause int, x double, y double"), "built")
    facts = both.where("kind = 'fact'").select("problem_id", predicate_key(F.col("name"), F.col("args")).alias("key"), "name", "args", F.lit(0).alias("level"), F.lit(None).cast("string").alias("rule"), F.array().cast("array<string>").alias("why"), "clause")
    facts = facts.groupBy("problem_id", "key").agg(F.min(F.struct("clause", "name", "args", "level", "rule", "why")).alias("f")).select("problem_id", "key", "f.name", "f.args", "f.level", "f.rule", "f.why", "f.clause")
    points = both.where("kind = 'point'").select("problem_id", F.col("name").alias("p"), F.struct("x", "y").alias("xy"))
    return facts, points


def _with_points(facts: DataFrame, points: DataFrame) -> DataFrame:
    """Each statement's facts with its diagram as one map."""
    diagram = points.groupBy("problem_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "xy"))).alias("diagram"))
    return facts.join(diagram, "problem_id")


def _xy(diagram) -> dict[str, tuple[float, float]]:
    return {k: (v["x"], v["y"]) for k, v in dict(diagram).items()}


def class_tables(facts: DataFrame, points: DataFrame, algebra: bool = True) -> dict[str, DataFrame]:
    """The tables that rules join on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = _xy(pdf["diagram"].iloc[0])
        k = Classes([(n, list(a)) for n, a in zip(pdf["name"], pdf["args"], strict=True)], xy, algebra)
        pid, rows, dirs, sizes = pdf["problem_id"].iloc[0], [], {}, {}
        for a in k.points:
            for b in k.points:
                if a != b:
                    d, size = k.direction(a, b), k.length(a, b)
                    rows.append((pid, "pair", a, b, k.line(a, b), d, size))
                    dirs.setdefault(d, (a, b))
                    sizes.setdefault(size, (a, b))
        for d1, p in dirs.items():
            for d2, q in dirs.items():
                v = "0" if d1 == d2 else k.angle(p, q)
                rows.append((pid, "ang", d1, d2, v, "square" if v == k.right else "", None))
        rows += [(pid, "rat", s1, s2, k.ratio(p, q), None, None) for s1, p in sizes.items() for s2, q in sizes.items()]
        rows += [(pid, "circ", c, p, None, None, None) for c in k.circles for p in c.split(" ")]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in TABLES.split(", ")])

    grouped = _with_points(facts.select("problem_id", "name", "args"), points).groupBy("problem_id").applyInPandas(run, TABLES)
    all_ = staged(grouped, "classes")
    of = lambda kind: all_.where(F.col("kind") == kind)
    at = points.select("problem_id", F.col("p").alias("__p"), F.col("xy").alias("__xy"))
    pair = of("pair").select("problem_id", F.col("c1").alias("a"), F.col("c2").alias("b"), F.col("c3").alias("line"), F.col("c4").alias("dir"), F.col("c5").alias("len"))
    for end in "ab":
        pair = pair.join(at.withColumnRenamed("__p", end).withColumnRenamed("__xy", f"p{end}"), ["problem_id", end])
    ang = of("ang").select("problem_id", F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("c3").alias("v"), F.col("c4").alias("square"))
    return {
        "pair": pair,
        "ang": ang,
        "perp": ang.where("square = 'square'").select("problem_id", "d1", "d2"),
        "rat": of("rat").select("problem_id", F.col("c1").alias("l1"), F.col("c2").alias("l2"), F.col("c3").alias("v")),
        "circ": of("circ").select("problem_id", F.col("c1").alias("circle"), F.col("c2").alias("p")),
        "point": points,
        "__all": all_,
    }


def absorb(facts: DataFrame, found: DataFrame, points: DataFrame, level: int, algebra: bool = True) -> DataFrame:
    """Facts and, of the conclusions found, those that don't follow from what stands before them; in the order of rules and keys."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = _xy(pdf["diagram"].iloc[0])
        old, new = pdf[pdf["level"] < level], pdf[pdf["level"] == level].sort_values(["rule", "key"])
        known = [(n, list(a)) for n, a in zip(old["name"], old["args"], strict=True)]
        k, keep = Classes(known, xy, algebra), []
        for i, n, a in zip(new.index, new["name"], new["args"], strict=True):
            if not k.holds(n, list(a)):
                keep.append(i)
                known.append((n, list(a)))
                if not k.add(n, list(a)):
                    k = Classes(known, xy, algebra)
        return pd.concat([old, new.loc[keep]]).drop(columns="diagram")

    new = found.select("problem_id", "key", "name", "args", F.lit(level).alias("level"), "rule", "why", F.lit(None).cast("int").alias("clause"))
    return _with_points(facts.select(*[x.split()[0] for x in FACTS.split(", ")]).unionByName(new), points).groupBy("problem_id").applyInPandas(run, FACTS)


def deduce(facts: DataFrame, points: DataFrame, rules: list[Rule] | None = None, algebra: bool = True, most_levels: int = 8, skip: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(facts at the fixpoint, levels run). Fewer than most_levels levels: saturated."""
    chosen = [r for r in (rules or standard_rules()) if r.name not in skip and not (algebra and r.name in BY_ALGEBRA)]
    now = staged(facts, "facts")
    size = now.count()
    for level in range(1, most_levels + 1):
        tables = class_tables(now, points, algebra)
        with ThreadPoolExecutor(max_workers=6) as pool:  # the rules' jobs are small and don't depend on each other
            found = list(pool.map(lambda r: staged(match(r, tables), r.name), chosen))
        union = found[0]
        for f in found[1:]:
            union = union.unionByName(f)
        best = union.groupBy("problem_id", "key").agg(F.min(F.struct("rule", "name", "args", "why")).alias("f")).select("problem_id", "key", "f.name", "f.args", "f.rule", "f.why")
        new = staged(best.join(now.select("problem_id", "key"), ["problem_id", "key"], "left_anti"), "found")
        grown = staged(absorb(now, new, points, level, algebra), "facts")
        for x in (now, new, tables["__all"], *found):
            unstaged(x)
        now, before = grown, size
        size = now.count()
        if size == before:
            return now, level
    return now, most_levels


def goals(facts: DataFrame, points: DataFrame, asked: DataFrame, algebra: bool = True) -> DataFrame:
    """(problem_id, solved) for asked (problem_id, goal as text); a goal about unknown points is not solved."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = Classes([(n, list(a)) for n, a in zip(pdf["name"], pdf["args"], strict=True)], _xy(pdf["diagram"].iloc[0]), algebra)
        out = [(g, k.holds(g.split(" ")[0], g.split(" ")[1:])) for g in sorted(set(pdf["goal"]))]
        return pd.DataFrame([(pdf["problem_id"].iloc[0], g, s) for g, s in out], columns=["problem_id", "goal", "solved"])

    rows = _with_points(facts.select("problem_id", "name", "args"), points).join(asked, "problem_id")
    return rows.groupBy("problem_id").applyInPandas(run, "problem_id string, goal string, solved boolean")


def prove(spark: SparkSession, statements: DataFrame, defs: dict[str, Definition] | None = None, rules: list[Rule] | None = None, algebra: bool = True, most_levels: int = 8, skip: tuple[str, ...] = ()) -> DataFrame:
    """(problem_id, status): solved, unsolved (saturated without it), level_limit, or error (unreadable, or no diagram)."""
    defs = defs or own_definitions()
    facts, points = build(spark, statements, defs)
    facts, points = staged(facts, "facts"), staged(points, "points")
    closed, _ = deduce(facts, points, rules, algebra, most_levels, skip)
    asked = statements.select("problem_id", F.trim(F.substring_index("statement", "?", -1)).alias("goal"))
    solved = goals(closed, points, asked, algebra).select("problem_id", "solved").join(closed.groupBy("problem_id").agg(F.max("level").alias("last")), "problem_id")
    # a statement that gained nothing in the last level allowed is saturated, whatever others in the run still gain
    status = F.when(F.col("solved").isNull(), "error").when(F.col("solved"), "solved").when(F.col("last") < most_levels, "unsolved").otherwise("level_limit")
    return statements.select("problem_id").join(solved, "problem_id", "left").select("problem_id", status.alias("status"))


# ---- explanation --------------------------------------------------------------------------------------------------------


def explain_goal(rows: list[dict], xy: dict, goal: str, algebra: bool = True) -> list[dict] | None:
    """The steps of a proof in order, each {fact, rule, premises}; rows are facts as dicts. None if the goal doesn't follow.

    Facts are dropped one by one as long as the goal still follows; the kept ones are explained by their premises in the same way,
    from earlier levels alone.
    """
    by_key = {r["key"]: r for r in rows}

    def needed(text: str, level: int) -> list[dict] | None:
        name, *args = text.split(" ")
        use = [r for r in rows if r["level"] < level]
        follows = lambda u: Classes([(r["name"], list(r["args"])) for r in u], xy, algebra).holds(name, args)
        if not follows(use):
            return None
        for r in sorted(use, key=lambda r: (-r["level"], r["key"])):
            rest = [u for u in use if u is not r]
            if follows(rest):
                use = rest
        return use

    steps: list[dict] = []
    done: set[str] = set()

    def visit(key: str) -> None:
        if key in done:
            return
        done.add(key)
        r = by_key[key]
        if not r["rule"]:
            steps.append({"fact": key, "rule": None, "premises": [], "clause": r["clause"]})
            return
        premises: list[str] = []
        for w in r["why"]:
            for u in needed(w, r["level"]) or []:
                visit(u["key"])
                premises.append(u["key"])
        steps.append({"fact": key, "rule": r["rule"], "premises": sorted(set(premises)), "clause": None})

    top = needed(goal, 1 << 30)
    if top is None:
        return None
    for r in top:
        visit(r["key"])
    steps.append({"fact": goal, "rule": "algebra" if algebra else "classes", "premises": sorted(r["key"] for r in top), "clause": None})
    return steps


def relied_on(text: str, defs: dict[str, Definition]) -> set[str]:
    """Points that a statement's goal rests on, through the points of their clauses."""
    s = statement(text)
    above = {p: set(c.points) | {a for points, _, _ in instance(c, defs) for a in points} | {a for _, args in c.constructions for a in args} for c in s.clauses for p in c.points}
    seen, todo = set(), list(s.goal[1]) if s.goal else []
    while todo:
        p = todo.pop()
        if p in above and p not in seen:
            seen.add(p)
            todo += above[p]
    return seen


def proof_table(facts: DataFrame, points: DataFrame, statements: DataFrame, defs: dict[str, Definition], algebra: bool = True) -> DataFrame:
    """(problem_id, step, fact, rule, premises, part): setup facts, auxiliary facts and numbered steps of each solved statement.

    A basic fact is setup if the goal's own points rest on its clause, else auxiliary.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["problem_id", "step", "fact", "rule", "premises", "part"]
        text = pdf["statement"].iloc[0]
        goal = text.partition("?")[2].strip()
        rows = pdf[["key", "name", "args", "level", "rule", "why", "clause"]].to_dict("records")
        for r in rows:
            r["rule"] = r["rule"] if isinstance(r["rule"], str) else None
            r["why"] = list(r["why"]) if r["why"] is not None else []
        steps = explain_goal(rows, _xy(pdf["diagram"].iloc[0]), goal, algebra)
        if steps is None:
            return pd.DataFrame([], columns=columns)
        own = relied_on(text, defs)
        clauses = statement(text).clauses
        part = lambda s: "step" if s["rule"] else "setup" if set(clauses[int(s["clause"])].points) <= own else "auxiliary"
        return pd.DataFrame([(pdf["problem_id"].iloc[0], i, s["fact"], s["rule"], s["premises"], part(s)) for i, s in enumerate(steps)], columns=columns)

    rows = _with_points(facts, points).join(statements.select("problem_id", "statement"), "problem_id")
    return rows.groupBy("problem_id").applyInPandas(run, "problem_id string, step int, fact string, rule string, premises array<string>, part string")


def proof_text(steps: DataFrame) -> DataFrame:
    """(problem_id, proof): premises, auxiliary facts and numbered steps as text."""
    line = F.when(F.col("part") == "step", F.concat(F.array_join("premises", ", "), F.lit(" => "), F.col("fact"), F.lit(" ["), F.col("rule"), F.lit("]"))).otherwise(F.concat(F.col("part"), F.lit(": "), F.col("fact")))
    return steps.groupBy("problem_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("l")))), lambda x: x["l"]), "\n").alias("proof"))


# ---- filters over candidates --------------------------------------------------------------------------------------------


def minimise(solve, clauses: list[str]) -> list[str]:
    """The smallest sufficient part of a target: all parts by size for up to 4 clauses, else single removals from the front again and again."""
    from itertools import combinations

    if len(clauses) <= 4:
        return next((list(c) for n in range(1, len(clauses) + 1) for c in combinations(clauses, n) if solve(list(c))), clauses)
    at, kept = 0, list(clauses)
    while at < len(kept):
        rest = kept[:at] + kept[at + 1 :]
        if rest and solve(rest):
            kept, at = rest, 0
        else:
            at += 1
    return kept


def beam_search(spark: SparkSession, statement_text: str, propose, beam: int = 4, depth: int = 2, defs: dict[str, Definition] | None = None, **how) -> dict:
    """Prove as is, else add proposed clauses: propose(statement) -> [(clause, score)]; scores add up along a branch.

    All candidates of a depth are proved in one run; the best `beam` of the unsolved go on.
    """
    defs = defs or own_definitions()
    status = lambda texts: {r.problem_id: r.status for r in prove(spark, spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "problem_id string, statement string"), defs, **how).collect()}
    if status([statement_text])["0"] == "solved":
        return {"solved": True, "statement": statement_text, "depth": 0, "tried": 0}
    nodes, tried = [(0.0, statement_text)], 0
    for level in range(1, depth + 1):
        made = []
        for score, text in nodes:
            head, _, goal = text.partition(" ? ")
            made += [(score + s, f"{head}; {c} ? {goal}") for c, s in propose(text)]
        made = list({t: (s, t) for s, t in sorted(made)}.values())
        if not made:
            break
        tried += len(made)
        got = status([t for _, t in made])
        for i, (score, text) in enumerate(made):
            if got[str(i)] == "solved":
                return {"solved": True, "statement": text, "depth": level, "tried": tried, "score": score}
        live = [(s, t) for i, (s, t) in enumerate(made) if got[str(i)] != "error"]
        nodes = sorted(live, key=lambda x: (-x[0], x[1]))[:beam]
    return {"solved": False, "statement": statement_text, "depth": depth, "tried": tried}
