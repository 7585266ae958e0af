"""Exact linear reasoning over the facts of one statement, and the classes that rules join on.

A system of linear equations over rationals is kept reduced: every variable is either free or a combination of free ones.
Two terms are equal exactly if their reduced forms are, so the reduced form is the class of a direction, an angle, a length or a ratio.
Lines have directions (in units of pi; the numeric diagram settles each equation's whole number of turns), segments have the logarithm of their length, in which
primes are variables too.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Term = dict  # variable -> Fraction
#: Predicates of similar and of congruent triangles.
TRIANGLES = ("simtri", "simtri2", "simtri*", "contri", "contri2", "contri*")


def plus(a: Term, b: Term, times: Fraction | int = 1) -> Term:
    out = dict(a)
    for k, v in b.items():
        new = out.get(k, 0) + v * times
        if new:
            out[k] = new
        else:
            out.pop(k, None)
    return out


class System:
    """Equations sum = 0, reduced as they come; `why` of an equation is the set of facts it rests on."""

    def __init__(self, constants: tuple[str, ...] = ()):
        self.constants = constants  # never solved for
        self.solved: dict[str, tuple[Term, frozenset]] = {}

    def reduce(self, term: Term) -> tuple[Term, frozenset]:
        out, why = {}, frozenset()
        for k, v in term.items():
            if k in self.solved:
                form, because = self.solved[k]
                out, why = plus(out, form, v), why | because
            else:
                out = plus(out, {k: Fraction(v)})
        return out, why

    def add(self, term: Term, why: frozenset = frozenset()) -> bool:
        """False if the equation says nothing new (or contradicts, which sound facts don't)."""
        form, because = self.reduce(term)
        free = sorted(k for k in form if k not in self.constants)
        if not free:
            return False
        pick, because = free[0], because | why
        rest = {k: -v / form[pick] for k, v in form.items() if k != pick}
        for k, (f, w) in list(self.solved.items()):
            if pick in f:
                times = f[pick]
                self.solved[k] = plus({x: v for x, v in f.items() if x != pick}, rest, times), w | because
        self.solved[pick] = rest, because
        return True

    def equal(self, a: Term, b: Term) -> bool:
        return not self.reduce(plus(a, b, -1))[0]


def explain(equations: list[tuple[str, Term]], goal: Term, constants: tuple[str, ...] = ()) -> list[str] | None:
    """A smallest-by-dropping set of named equations from which goal = 0 follows; None if it doesn't follow from all."""

    def follows(names: list[str]) -> bool:
        system = System(constants)
        for n, t in equations:
            if n in names:
                system.add(t)
        return not system.reduce(goal)[0]

    kept = [n for n, _ in equations]
    if not follows(kept):
        return None
    for n in list(kept):
        if follows([k for k in kept if k != n]):
            kept.remove(n)
    return kept


def merged_groups(groups: list[set], more: list[set]) -> tuple[list[set], list[tuple]]:
    """Groups after merging with more, in order of their first member's group, and the links between neighbours that were added."""
    out, links = [set(g) for g in groups], []
    for new in more:
        touched = [g for g in out if g & new]
        links += [(a, b) for a, b in zip(sorted(new), sorted(new)[1:], strict=False) if not any({a, b} <= g for g in out)]
        union = set(new).union(*touched)
        at = out.index(touched[0]) if touched else len(out)
        out = [g for g in out if g not in touched]
        out.insert(min(at, len(out)), union)
    return out, links


class Sets:
    """Disjoint sets over any keys."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _merged_by(sets: list[frozenset], common: int) -> list[frozenset]:
    """Point sets, those with `common` points in common made one."""
    out: list[frozenset] = []
    todo = list(sets)
    while todo:
        s = todo.pop()
        hit = next((o for o in out if len(o & s) >= common), None)
        if hit is None:
            out.append(s)
        elif not s <= hit:
            out.remove(hit)
            todo.append(hit | s)
    return out


def _factors(n: int) -> Term:
    out, p = {}, 2
    while n > 1:
        while n % p == 0:
            out[f"log {p}"] = out.get(f"log {p}", 0) + Fraction(1)
            n //= p
        p += 1
    return out


def fact_equations(name: str, args: list[str], turn) -> tuple[list[Term], list[Term]]:
    """Equations of a fact over directions `d <line>` and logarithms of lengths `l <pair>`, as (directions, lengths).

    turn(pairs) gives the directions' variables and the whole number that makes the equation true in the diagram.
    """
    seg = lambda a, b: {"l " + " ".join(sorted((a, b))): Fraction(1)}
    a = args
    if name == "para":
        return [turn([(a[0], a[1], 1), (a[2], a[3], -1)], Fraction(0))], []
    if name == "perp":
        return [turn([(a[0], a[1], 1), (a[2], a[3], -1)], Fraction(1, 2))], []
    if name == "aconst":
        top, _, low = a[4].partition("pi/")
        return [turn([(a[2], a[3], 1), (a[0], a[1], -1)], Fraction(int(top), int(low)))], []
    if name in ("eqangle", "eqangle6"):
        return [turn([(a[0], a[1], -1), (a[2], a[3], 1), (a[4], a[5], 1), (a[6], a[7], -1)], Fraction(0))], []
    if name == "cong":
        return [], [plus(seg(a[0], a[1]), seg(a[2], a[3]), -1)]
    if name in ("eqratio", "eqratio6"):
        return [], [plus(plus(seg(a[0], a[1]), seg(a[2], a[3]), -1), plus(seg(a[4], a[5]), seg(a[6], a[7]), -1), -1)]
    if name == "rconst":
        top, _, low = a[4].partition("/")
        return [], [plus(plus(plus(seg(a[0], a[1]), seg(a[2], a[3]), -1), _factors(int(top)), -1), _factors(int(low)))]
    if name == "midp":
        return [], [plus(seg(a[0], a[1]), seg(a[0], a[2]), -1), plus(plus(seg(a[1], a[2]), seg(a[0], a[1]), -1), _factors(2), -1)]
    if name == "circle":
        return [], [plus(seg(a[0], a[1]), seg(a[0], p), -1) for p in a[2:]]
    if name == "eqratio3":
        x, y, z, w, o, _ = a
        return [], [plus(plus(seg(o, p), seg(o, q), -1), plus(seg(o, r), seg(o, s), -1), -1) for p, q, r, s in ((x, z, y, w),)] + [plus(plus(seg(x, y), seg(z, w), -1), plus(seg(o, x), seg(o, z), -1), -1)]
    if name in TRIANGLES:
        one, two = a[:3], a[3:]
        pairs = list(combinations(range(3), 2))
        if name.startswith("contri"):
            lengths = [plus(seg(one[i], one[j]), seg(two[i], two[j]), -1) for i, j in pairs]
        else:
            lengths = [plus(plus(seg(one[i], one[j]), seg(two[i], two[j]), -1), plus(seg(one[k], one[m]), seg(two[k], two[m]), -1), -1) for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False)]
        return [], lengths
    return [], []


class Classes:
    """What the facts of one statement make equal. xy: coordinates of its points."""

    def __init__(self, facts: list[tuple[str, list[str]]], xy: dict[str, tuple[float, float]], algebra: bool = True):
        self.xy, self.points = xy, sorted(xy)
        lines = [frozenset(a) for n, a in facts if n == "coll"] + [frozenset(a) for n, a in facts if n == "midp"]
        lines = [x for x in lines if len(x) > 2]
        self.lines = _merged_by(lines, 2)
        self.line_of = {}
        for x in self.lines:
            for p in combinations(sorted(x), 2):
                self.line_of[p] = " ".join(sorted(x))
        self.circles = sorted({" ".join(sorted(c)) for c in _merged_by([frozenset(a) for n, a in facts if n == "cyclic" and len(set(a)) > 3], 3)})
        self.algebra = algebra
        self.angles, self.lengths = System(("pi",)), System(tuple(f"log {p}" for p in (2, 3, 5, 7, 11, 13)))
        self.flat = Sets()
        for name, args in facts:
            directions, lengths = fact_equations(name, args, self.turn)
            for t in directions:
                if algebra or name == "para":
                    self.angles.add(t)
            for t in lengths:
                if algebra or name in ("cong", "circle", "midp", "contri", "contri2", "contri*") and not any(k.startswith("log") for k in t):
                    self.lengths.add(t)
        for name, args in facts:
            if name in TRIANGLES:
                for eq in self._corners(args):
                    if algebra:
                        sign = 1 if eq[0] else -1
                        self.angles.add(self.turn([(*eq[1], -1), (*eq[2], 1), (*eq[3], sign), (*eq[4], -sign)], Fraction(0)))
                    else:
                        one, two = (eq[3], eq[4]) if eq[0] else (eq[4], eq[3])
                        self._flat("eqangle", [*eq[1], *eq[2], *one, *two])
        if not algebra:
            for name, args in facts:
                self._flat(name, args)

    def add(self, name: str, args: list[str]) -> bool:
        """Take in one more fact; False if that needs the classes made anew: lines and circles may merge, and without algebra chains start from classes."""
        if not self.algebra or name in ("coll", "midp", "cyclic"):
            return False
        directions, lengths = fact_equations(name, args, self.turn)
        for t in directions:
            self.angles.add(t)
        for t in lengths:
            self.lengths.add(t)
        if name in TRIANGLES:
            for same, *arms in self._corners(args):
                sign = 1 if same else -1
                self.angles.add(self.turn([(*arms[0], -1), (*arms[1], 1), (*arms[2], sign), (*arms[3], -sign)], Fraction(0)))
        return True

    def _corners(self, args: list[str]) -> list[tuple]:
        """(same sense, arms of a corner, arms of its counterpart) of similar triangles; the diagram tells the sense."""
        one, two = args[:3], args[3:]

        def sense(t):
            (x1, y1), (x2, y2), (x3, y3) = (self.xy[p] for p in t)
            return (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) > 0

        same = sense(one) == sense(two)
        return [(same, (one[i], one[j]), (one[i], one[k]), (two[i], two[j]), (two[i], two[k])) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]

    def line(self, a: str, b: str) -> str:
        pair = (a, b) if a < b else (b, a)
        return self.line_of.get(pair, " ".join(pair))

    def theta(self, a: str, b: str) -> float:
        """Direction of the line through two points, in [0, 1) of pi; taken from one fixed pair of its points."""
        p, q = self.line(a, b).split(" ")[:2]
        (x1, y1), (x2, y2) = self.xy[p], self.xy[q]
        t = math.atan2(y2 - y1, x2 - x1) / math.pi % 1.0
        return 0.0 if t > 1 - 1e-9 else t

    def turn(self, pairs: list[tuple[str, str, int]], value: Fraction) -> Term:
        """sum of signed directions = value + k, with the k of the diagram."""
        term: Term = {}
        for a, b, sign in pairs:
            term = plus(term, {"d " + self.line(a, b): Fraction(sign)})
        seen = sum(sign * self.theta(a, b) for a, b, sign in pairs)
        k = round(seen - float(value))
        return plus(term, {"pi": value + k}, -1)

    def _flat(self, name: str, args: list[str]) -> None:
        """Without algebra: angles and ratios are equal only along chains of facts."""
        a = args
        if name == "perp":
            d1, d2 = self.direction(a[0], a[1]), self.direction(a[2], a[3])
            self.flat.join(("angle", d1, d2), ("angle", "perp", ""))
            self.flat.join(("angle", d2, d1), ("angle", "perp", ""))
        elif name in ("eqangle", "eqangle6"):
            d = [self.direction(a[i], a[i + 1]) for i in (0, 2, 4, 6)]
            self.flat.join(("angle", d[0], d[1]), ("angle", d[2], d[3]))
            self.flat.join(("angle", d[1], d[0]), ("angle", d[3], d[2]))
        elif name in ("eqratio", "eqratio6"):
            s = [self.length(a[i], a[i + 1]) for i in (0, 2, 4, 6)]
            self.flat.join(("ratio", s[0], s[1]), ("ratio", s[2], s[3]))
            self.flat.join(("ratio", s[1], s[0]), ("ratio", s[3], s[2]))
        elif name in ("simtri", "simtri2", "simtri*"):
            one, two = a[:3], a[3:]
            for (i, j), (k, m) in permutations(list(combinations(range(3), 2)), 2):
                self.flat.join(("ratio", self.length(one[i], one[j]), self.length(one[k], one[m])), ("ratio", self.length(two[i], two[j]), self.length(two[k], two[m])))
        elif name == "eqratio3":
            x, y, z, w, o, _ = a
            self.flat.join(("ratio", self.length(o, x), self.length(o, z)), ("ratio", self.length(o, y), self.length(o, w)))

    @staticmethod
    def _told(term: Term, whole: bool) -> str:
        if whole and "pi" in term:
            term = plus({k: v for k, v in term.items() if k != "pi"}, {"pi": term["pi"] % 1} if term["pi"] % 1 else {})
        return "+".join(f"{v}*{k}" for k, v in sorted(term.items())) or "0"

    def direction(self, a: str, b: str) -> str:
        return self._told(self.angles.reduce({"d " + self.line(a, b): Fraction(1)})[0], True)

    def length(self, a: str, b: str) -> str:
        return self._told(self.lengths.reduce({"l " + " ".join(sorted((a, b))): Fraction(1)})[0], False)

    def angle(self, p: tuple[str, str], q: tuple[str, str]) -> str:
        if not self.algebra:
            d1, d2 = self.direction(*p), self.direction(*q)
            return " ".join(self.flat.root(("angle", d1, d2)))
        return self._told(self.angles.reduce(plus({"d " + self.line(*q): Fraction(1)}, {"d " + self.line(*p): Fraction(1)}, -1))[0], True)

    def ratio(self, p: tuple[str, str], q: tuple[str, str]) -> str:
        if not self.algebra:
            s1, s2 = self.length(*p), self.length(*q)
            return "1" if s1 == s2 else " ".join(self.flat.root(("ratio", s1, s2)))
        seg = lambda x: {"l " + " ".join(sorted(x)): Fraction(1)}
        return self._told(self.lengths.reduce(plus(seg(p), seg(q), -1))[0], False)

    @property
    def right(self) -> str:
        return "1/2*pi" if self.algebra else " ".join(self.flat.root(("angle", "perp", "")))

    def holds(self, name: str, args: list[str]) -> bool:
        """Whether the fact follows from these classes alone."""
        a = list(args)
        two = [(a[i], a[i + 1]) for i in range(0, len(a) - 1, 2)]
        if any(p not in self.xy for p in a if name not in ("aconst", "rconst")) or any(x == y for x, y in two if name in ("para", "perp", "cong", "eqangle", "eqratio")):
            return False
        if name == "coll":
            return len(set(a)) < 3 or any(set(a) <= x for x in self.lines)
        if name == "cyclic":
            return any(set(a) <= set(c.split(" ")) for c in self.circles)
        if name == "para":
            return self.line(*two[0]) != self.line(*two[1]) and self.direction(*two[0]) == self.direction(*two[1])
        if name == "perp":
            return self.angle(*two) == self.right
        if name == "cong":
            return self.length(*two[0]) == self.length(*two[1])
        if name == "midp":
            return self.holds("coll", a) and self.length(a[0], a[1]) == self.length(a[0], a[2])
        if name == "circle":
            return len({self.length(a[0], p) for p in a[1:]}) == 1
        if name in ("eqangle", "eqangle6"):
            return self.angle(*two[:2]) == self.angle(*two[2:])
        if name in ("eqratio", "eqratio6"):
            return self.ratio(*two[:2]) == self.ratio(*two[2:])
        if name == "eqratio3":
            return self.ratio((a[4], a[0]), (a[4], a[2])) == self.ratio((a[4], a[1]), (a[4], a[3]))
        if name in TRIANGLES:
            r = [self.ratio((a[i], a[j]), (a[i + 3], a[j + 3])) for i, j in combinations(range(3), 2)]
            return len(set(r)) == 1 and (not name.startswith("contri") or self.length(a[0], a[1]) == self.length(a[3], a[4]))
        if name == "aconst":
            top, _, low = a[4].partition("pi/")
            return self.angle((a[0], a[1]), (a[2], a[3])) == self._told({"pi": Fraction(int(top), int(low))}, True)
        if name == "rconst":
            top, _, low = a[4].partition("/")
            return self.ratio(*two[:2]) == self._told(plus(_factors(int(top)), _factors(int(low)), -1), False)
        return False


def linear(text: str) -> Term:
    """`a - b + 2 c` as a term."""
    out: Term = {}
    for sign, number, name in re.findall(r"([+-]?)\s*(\d+(?:/\d+)?)?\s*([A-Za-z_]\w*)", text):
        out = plus(out, {name: Fraction(number or 1) * (-1 if sign == "-" else 1)})
    return out


#: Different problems whose answers a task keeps.
ANSWERS = 1 << 14


def explained(equations: DataFrame, goals: DataFrame) -> DataFrame:
    """(problem_id, goal, holds, why): equations (problem_id, fact, equation), each text being 0; goals likewise.

    Exact elimination per problem; why is a set of facts that is needed to the last one. A problem comes as one row with its equations, and problems of the same texts
    are worked out once in a task.
    """
    kinds = goals.schema
    fact = F.struct(F.col("fact").cast("string").alias("fact"), F.col("equation").cast("string").alias("equation"))
    told = equations.select("problem_id", fact.alias("known"), F.lit(None).cast("string").alias("goal"))
    asked = goals.select("problem_id", F.lit(None).cast(told.schema["known"].dataType).alias("known"), F.col("goal").cast("string").alias("goal"))
    # grouped by a structure: Spark takes a union of tables that are dealt by problem for dealt already, and adaptive execution then joins its sides' partitions unevenly
    met = told.union(asked).groupBy(F.struct("problem_id").alias("problem")).agg(F.sort_array(F.collect_list("known")).alias("known"), F.collect_list("goal").alias("goals")).where(F.size("goals") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(ANSWERS)
        def answer(facts: tuple[str, ...], texts: tuple[str, ...], goal: str) -> list[str] | None:
            return explain([(f, linear(e)) for f, e in zip(facts, texts, strict=True)], linear(goal))

        for batch in batches:
            facts, texts, asked = (batch.column(i).to_pylist() for i in (1, 2, 3))
            at, told, why = [], [], []
            for i, (f, e, some) in enumerate(zip(facts, texts, asked, strict=True)):
                f, e = tuple(f), tuple(e)
                for goal in some:
                    at.append(i)
                    told.append(goal)
                    why.append(answer(f, e, goal))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(told, pa.string()), pa.array([w is not None for w in why], pa.bool_()), pa.array([w or [] for w in why], pa.list_(pa.string()))],
                names=["problem_id", "goal", "holds", "why"],
            )

    rows = met.select("problem.problem_id", F.col("known.fact").alias("facts"), F.col("known.equation").alias("texts"), "goals")
    return rows.mapInArrow(run, f"problem_id {kinds['problem_id'].dataType.simpleString()}, goal string, holds boolean, why array<string>")
