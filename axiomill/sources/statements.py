"""Statements, definitions and rules: their text forms, and readers that give one row per record.

A statement is `points = name args, name args; ... ? goal`; its file alternates lines of names and statements. A definition is a
record of five lines and a blank one: signature, which points rest on which, requirements, basic facts by group of points, sketches. A
rule is `premise, premise => conclusion`, one to a line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Atom = tuple[str, tuple[str, ...]]


@dataclass
class Clause:
    points: list[str]
    constructions: list[Atom]
    at: dict[str, tuple[float, float]] = field(default_factory=dict)

    def text(self) -> str:
        return f"{' '.join(self.points)} = {', '.join(' '.join((n, *a)) for n, a in self.constructions)}"


@dataclass
class Statement:
    clauses: list[Clause]
    goal: Atom | None = None

    def text(self) -> str:
        return "; ".join(c.text() for c in self.clauses) + (f" ? {' '.join((self.goal[0], *self.goal[1]))}" if self.goal else "")


@dataclass
class Definition:
    name: str
    points: list[str]
    args: list[str]
    requires: list[Atom]
    basics: list[tuple[list[str], list[Atom]]]
    sketches: list[Atom]

    @property
    def signature(self) -> list[str]:
        return self.args


@dataclass
class Rule:
    name: str
    premises: list[Atom]
    conclusion: Atom


def atom(text: str) -> Atom:
    name, *args = text.split()
    return name, tuple(args)


def atoms(text: str) -> list[Atom]:
    return [atom(x) for x in text.split(",") if x.strip()]


def clause(text: str) -> Clause:
    left, _, right = text.partition("=")
    points, at = [], {}
    for p in left.split():
        name, pinned, where = p.partition("@")
        points.append(name)
        if pinned:
            x, y = where.split("_")
            at[name] = (float(x), float(y))
    return Clause(points, atoms(right), at)


def clauses(text: str) -> list[Clause]:
    return [clause(c) for c in text.split(";") if c.strip()]


def statement(text: str) -> Statement:
    body, asked, goal = text.partition("?")
    return Statement(clauses(body), atom(goal) if asked and goal.strip() else None)


def point_name(i: int) -> str:
    """a ... z, then a1 ... z1 and so on."""
    return chr(97 + i % 26) + (str(i // 26) if i >= 26 else "")


def renamed(s: Statement) -> Statement:
    """Points named in the order in which they are defined."""
    names: dict[str, str] = {}
    for c in s.clauses:
        for p in c.points:
            names.setdefault(p, point_name(len(names)))
    to = lambda args: tuple(names.get(a, a) for a in args)
    return Statement([Clause([names[p] for p in c.points], [(n, to(a)) for n, a in c.constructions], {names[p]: v for p, v in c.at.items()}) for c in s.clauses], s.goal and (s.goal[0], to(s.goal[1])))


def definition(lines: list[str]) -> Definition:
    head, rely, requires, basics, sketches = (x.strip() for x in lines[:5])
    name, *args = head.split()
    groups = []
    for part in (x for x in basics.lstrip("=").split(";") if ":" in x):
        points, _, facts = part.partition(":")
        groups.append((points.lstrip("= ").split(), atoms(facts)))
    new = [p for p, _ in groups]
    return Definition(name, [p for g in new for p in g], args, atoms(requires.partition("=")[2]), groups, atoms(sketches))


def definitions(text: str) -> dict[str, Definition]:
    records = [r.split("\n") for r in re.split(r"\n[ \t]*\n(?=[A-Za-z0-9_]+ )", text.strip("\n")) if r.strip()]
    found = [definition([*r, "", "", "", ""][:5]) for r in records]
    return {d.name: d for d in found}


def rules(text: str) -> list[Rule]:
    out = []
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        if line:
            left, _, right = line.partition("=>")
            made = atoms(right)
            if len(made) != 1:
                raise ValueError(f"a rule has one conclusion: {line}")
            out.append(Rule(f"r{len(out):02d}", atoms(left), made[0]))
    return out


# ---- readers ----------------------------------------------------------------------------------------------------------


def read_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, record, lines): non-comment lines of each file in groups of `size`. A file is one row; statement files are small."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("v"))
    lines = whole.select("file", F.posexplode("v").alias("pos", "line"))
    groups = lines.groupBy("file", F.floor(F.col("pos") / size).cast("long").alias("record")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("v"))
    return groups.select("file", "record", F.transform("v", lambda x: x["line"]).alias("lines"))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(problem_id, statement) of files of alternating names and statements."""
    found = read_records(spark, path, 2).select(F.trim(F.get("lines", F.lit(0))).alias("problem_id"), F.trim(F.get("lines", F.lit(1))).alias("statement"))
    return found.where("problem_id <> '' and statement is not null and statement <> ''")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, premises, conclusion) by line; comments and blank lines have no number."""
    lines = read_records(spark, path, 1).select("file", "record", F.trim(F.split(F.get("lines", F.lit(0)), "#")[0]).alias("line")).where("line <> ''")
    number = F.row_number().over(Window.partitionBy("file").orderBy("record")) - 1
    parts = F.split("line", "=>")
    return lines.select(F.format_string("r%02d", number).alias("rule"), F.transform(F.split(parts[0], ","), lambda p: F.trim(p)).alias("premises"), F.trim(parts[1]).alias("conclusion"))
