"""Rules as join plans. Every rule text becomes one chain of equi-joins over class tables; Catalyst picks the joins.

Tables (all with problem_id): pair(a, b, pa, pb, line, dir, len) for every ordered pair of points, ang(d1, d2, v, square) and
rat(l1, l2, v) for pairs of classes, circ(circle, p). Equality of directions, lengths, angles and ratios is equality of class ids, so a premise is
a few equi-joins and never a comparison of all with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill.functions import numeric
from axiomill.functions.keys import canonical_args, predicate_key
from axiomill.sources.statements import Rule, rules

#: The deduction rules, in the order that gives them their names r00, r01, ...
RULES = """
perp A B C D, perp C D E F, ncoll A B E => para A B E F
cong O A O B, cong O B O C, cong O C O D => cyclic A B C D
eqangle A B P Q C D P Q => para A B C D
cyclic A B P Q => eqangle P A P B Q A Q B
eqangle6 P A P B Q A Q B, ncoll P Q A B => cyclic A B P Q
cyclic A B C P Q R, eqangle C A C B R P R Q => cong A B P Q
midp E A B, midp F A C => para E F B C
para A B C D, coll O A C, coll O B D => eqratio3 A B C D O O
perp A B C D, perp E F G H, npara A B E F => eqangle A B E F C D G H
eqangle a b c d m n p q, eqangle c d e f p q r u => eqangle a b e f m n r u
eqratio a b c d m n p q, eqratio c d e f p q r u => eqratio a b e f m n r u
eqratio6 d b d c a b a c, coll d b c, ncoll a b c => eqangle6 a b a d a d a c
eqangle6 a b a d a d a c, coll d b c, ncoll a b c => eqratio6 d b d c a b a c
cong O A O B, ncoll O A B => eqangle O A A B A B O B
eqangle6 A O A B B A B O, ncoll O A B => cong O A O B
circle O A B C, perp O A A X => eqangle A X A B C A C B
circle O A B C, eqangle A X A B C A C B => perp O A A X
circle O A B C, midp M B C => eqangle A B A C O B O M
circle O A B C, coll M B C, eqangle A B A C O B O M => midp M B C
perp A B B C, midp M A C => cong A M B M
circle O A B C, coll O A C => perp A B B C
cyclic A B C D, para A B C D => eqangle A D C D C D C B
midp M A B, perp O M A B => cong O A O B
cong A P B P, cong A Q B Q => perp A B P Q
cong A P B P, cong A Q B Q, cyclic A B P Q => perp P A A Q
midp M A B, midp M C D => para A C B D
midp M A B, para A C B D, para A D B C => midp M C D
eqratio O A A C O B B D, coll O A C, coll O B D, ncoll A B C, sameside A O C B O D => para A B C D
para A B A C => coll A B C
midp M A B, midp N C D => eqratio M A A B N C C D
eqangle A B P Q C D U V, perp P Q U V => perp A B C D
eqratio A B P Q C D U V, cong P Q U V => cong A B C D
cong A B P Q, cong B C Q R, cong C A R P, ncoll A B C => contri* A B C P Q R
cong A B P Q, cong B C Q R, eqangle6 B A B C Q P Q R, ncoll A B C => contri* A B C P Q R
eqangle6 B A B C Q P Q R, eqangle6 C A C B R P R Q, ncoll A B C => simtri A B C P Q R
eqangle6 B A B C Q R Q P, eqangle6 C A C B R Q R P, ncoll A B C => simtri2 A B C P Q R
eqangle6 B A B C Q P Q R, eqangle6 C A C B R P R Q, ncoll A B C, cong A B P Q => contri A B C P Q R
eqangle6 B A B C Q R Q P, eqangle6 C A C B R Q R P, ncoll A B C, cong A B P Q => contri2 A B C P Q R
eqratio6 B A B C Q P Q R, eqratio6 C A C B R P R Q, ncoll A B C => simtri* A B C P Q R
eqratio6 B A B C Q P Q R, eqangle6 B A B C Q P Q R, ncoll A B C => simtri* A B C P Q R
eqratio6 B A B C Q P Q R, eqratio6 C A C B R P R Q, ncoll A B C, cong A B P Q => contri* A B C P Q R
para a b c d, coll m a d, coll n b c, eqratio6 m a m d n b n c, sameside m a d n b c => para m n a b
para a b c d, coll m a d, coll n b c, para m n a b => eqratio6 m a m d n b n c
"""

GUARDS = ("ncoll", "npara", "nperp", "sameside", "diff")
#: The rules whose chains of equal angles, ratios and lengths the algebra follows by itself.
#: The rules whose different variables stand for different points. In the others two figures may share points.
INJECTIVE = ("r06", "r07", "r13", "r17", "r18", "r19", "r20", "r21", "r23", "r24", "r25", "r26", "r27", "r28", "r29", "r31", "r41", "r42")
BY_ALGEBRA = ("r02", "r08", "r09", "r10", "r30", "r31")


def standard_rules() -> list[Rule]:
    return rules(RULES)


def _atoms(rule: Rule) -> tuple[list[tuple[str, dict[str, str]]], list[tuple[str, str]]]:
    """(table, column -> variable) atoms and pairs of class variables that must differ. Points are p_<name>, classes c<n>."""
    out, differ, n = [], [], 0

    def pair(a: str, b: str, **classes: str) -> None:
        out.append(("pair", {"a": f"p_{a}", "b": f"p_{b}", **classes}))

    def fresh() -> str:
        nonlocal n
        n += 1
        return f"c{n}"

    for name, args in rule.premises:
        two = [(args[i], args[i + 1]) for i in range(0, len(args) - 1, 2)]
        if name in GUARDS:
            continue
        if name == "coll":
            line = fresh()
            for p in args[1:]:
                pair(args[0], p, line=line)
        elif name == "para":
            d, l1, l2 = fresh(), fresh(), fresh()
            pair(*two[0], dir=d, line=l1)
            pair(*two[1], dir=d, line=l2)
            if rule.conclusion[0] != "coll":
                differ.append((l1, l2))
        elif name == "perp":
            d1, d2 = fresh(), fresh()
            pair(*two[0], dir=d1)
            out.append(("perp", {"d1": d1, "d2": d2}))
            pair(*two[1], dir=d2)
        elif name in ("cong", "circle"):
            size = fresh()
            for a, b in two if name == "cong" else [(args[0], p) for p in args[1:]]:
                pair(a, b, len=size)
        elif name == "midp":
            line, size = fresh(), fresh()
            pair(args[0], args[1], line=line, len=size)
            pair(args[0], args[2], line=line, len=size)
        elif name == "cyclic":
            circle = fresh()
            out.extend(("circ", {"circle": circle, "p": f"p_{p}"}) for p in args)
        elif name in ("eqangle", "eqangle6", "eqratio", "eqratio6"):
            kind, table, names = ("dir", "ang", ("d1", "d2")) if "angle" in name else ("len", "rat", ("l1", "l2"))
            c, v = [fresh() for _ in range(4)], fresh()
            for (a, b), k in zip(two, c, strict=True):
                pair(a, b, **{kind: k})
            out.append((table, {names[0]: c[0], names[1]: c[1], "v": v}))
            out.append((table, {names[0]: c[2], names[1]: c[3], "v": v}))
        else:
            raise ValueError(f"no table holds {name}")
    return out, differ


def _ordered(atoms: list[tuple[str, dict[str, str]]], wanted: set[str]) -> list[tuple[str, dict[str, str]]]:
    """Each next atom shares as many variables as possible with those before it; of equal ones those come first that nothing but the premises needs."""
    todo, out, bound = list(atoms), [], set()
    while todo:
        spare = lambda x: sum(v.startswith("p_") for v in set(x[1].values()) - wanted)
        best = max(todo, key=lambda x: (len(bound & set(x[1].values())) - 0.5 * len(set(x[1].values()) - bound), x[0] != "pair" and bool(bound), spare(x), -todo.index(x)))
        todo.remove(best)
        out.append(best)
        bound |= set(best[1].values())
    return out


def _apart(rule: Rule) -> set[frozenset]:
    """Pairs of variables that stand for different points: all for injective rules, else those that the conclusion needs apart."""
    name, args = rule.conclusion
    every = sorted({p for n, a in [*rule.premises, rule.conclusion] for p in a})
    if rule.name in INJECTIVE or rule.name.startswith("x"):
        return {frozenset((f"p_{a}", f"p_{b}")) for a, b in combinations(every, 2)}
    if name in ("coll", "cyclic", "midp"):
        return {frozenset((f"p_{a}", f"p_{b}")) for a, b in combinations(args, 2)}
    sides = combinations(args[:3], 2) if "tri" in name else zip(args[::2], args[1::2], strict=False)
    out = {frozenset((f"p_{a}", f"p_{b}")) for a, b in sides if a != b}
    for n, a in rule.premises:  # points of one figure are apart, as are the ends of a segment
        if n in ("circle", "midp", "cyclic", "coll"):
            out |= {frozenset((f"p_{x}", f"p_{y}")) for x, y in combinations(a, 2)}
    return out


@contextmanager
def problems_together(spark: SparkSession) -> Iterator[None]:
    """What is run inside joins tables that are dealt by problem_id where they are: a join or grouping over more columns deals nothing anew.

    For many problems of which each fits a task. Few large ones are better dealt by all columns of a join, which is what holds outside.
    """
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def match(rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    """(problem_id, name, args, key, rule, why) of the rule's conclusions; why has its premises as text, the first in order of those that give it.

    A point that no later join, guard or conclusion needs leaves the state as soon as it can: of the points that could stand there the first in the order of
    why is kept. So chains over a point in the middle don't multiply what comes before it with what comes after.
    """
    atoms, differ = _atoms(rule)
    state, bound, at = None, set(), {}
    apart = _apart(rule)
    ends = {f"p_{p}" for n, a in [*(x for x in rule.premises if x[0] in GUARDS), rule.conclusion] for p in a}
    told = list(dict.fromkeys(f"p_{p}" for n, a in rule.premises if n not in GUARDS for p in a))  # as they come in why
    kept_as: list[str] = []  # points that have left the state, but for the ones that why tells
    chain = _ordered(atoms, ends)
    for step, (table, columns) in enumerate(chain):
        source = tables[table]
        seen: dict[str, str] = {}
        tests = []
        for column, var in columns.items():
            if var in seen:
                source = source.where(F.col(column) == F.col(seen[var]))
            else:
                seen[var] = column
        picked = [F.col(c).alias(v) for v, c in seen.items()]
        for v, c in seen.items():
            if table == "pair" and c in ("a", "b") and v not in at:
                at[v] = f"xy_{v}"
                picked.append(F.col("p" + c).alias(at[v]))
        part = source.select("problem_id", *picked)
        new = [v for v in seen if v.startswith("p_") and v not in bound]
        if state is None:
            state = part
            tests += [f"{v} <> {w}" for v, w in combinations(sorted(new), 2) if frozenset((v, w)) in apart]
        else:
            state = state.join(part, ["problem_id", *sorted(bound & set(seen))])
            # different variables, different points: the sooner the better
            tests += [f"{v} <> {w}" for v in new for w in sorted(bound) if frozenset((v, w)) in apart]
        if tests:  # one filter for each join: every step of a frame is analysed anew
            state = state.where(" AND ".join(tests))
        bound |= set(seen)
        later = {v for _, c in chain[step + 1 :] for v in c.values()}
        needed = later | ends | {v for pair in differ for v in pair} | {v for pair in apart if pair & (later - bound) for v in pair}
        gone = [v for v in told if v in bound - needed]
        if gone and later:
            bound = {v for v in bound if v in needed}
            kept_as = [v for v in told if v in {*kept_as, *gone}]
            for v in gone:
                at.pop(v, None)
            by = ["problem_id", *sorted(bound), *sorted(at[v] for v in bound if v in at)]
            state = state.groupBy(*by).agg(F.min(F.struct(*kept_as)).alias("kept")).select(*by, *[f"kept.{v}" for v in kept_as])
    for v in sorted(x for x in bound if x.startswith("p_") and x not in at):
        points = tables["point"].select("problem_id", F.col("p").alias(v), F.col("xy").alias(f"xy_{v}"))
        state, at[v] = state.join(points, ["problem_id", v]), f"xy_{v}"
    if differ:
        state = state.where(" AND ".join(f"{v} <> {w}" for v, w in differ))
    xy = lambda p: F.col(at[f"p_{p}"])
    for name, args in rule.premises:
        if name in GUARDS:
            state = state.where(numeric.holds(name, *(xy(p) for p in args)))
    name, args = rule.conclusion
    if "tri" in name:  # directed angles do not tell a triangle from its supplement; the diagram does
        state = state.where(numeric.holds(name, *(xy(p) for p in args)))
    said = lambda n, a: F.concat_ws(" ", F.lit(n), *(F.col(f"p_{p}") for p in a))
    plain = {"eqangle6": "eqangle", "eqratio6": "eqratio"}.get(name, name)
    made = F.array(*(F.col(f"p_{p}") for p in args))
    key = predicate_key(plain, made).alias("key")  # tells the arguments, so these need no place among the keys
    out = state.select("problem_id", key, F.struct(F.lit(rule.name).alias("rule"), F.array(*(said(n, a) for n, a in rule.premises if n not in GUARDS)).alias("why"), canonical_args(plain, made).alias("args")).alias("by"))
    return out.groupBy("problem_id", "key").agg(F.min("by").alias("by")).select("problem_id", F.lit(plain).alias("name"), "by.args", "key", "by.rule", "by.why")
