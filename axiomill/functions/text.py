"""Column functions over corpus and statement texts; all but the renaming of points stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is, and which tokens name points.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[^ \t\n\r\f]"
#: A token that is a lower-case letter and digits names a point.
_TOKENS = re.compile(r"([a-z][0-9]*(?![A-Za-z0-9_]))|([A-Za-z_][A-Za-z0-9_]*|[^ \t\n\r\f])")
SPACES = r"[ \t\n\r\f]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def canonical_shape(text: Column) -> Column:
    """Tokens joined by spaces, with points renamed P0, P1, ... in the order in which they first appear; null for a null text.

    Names depend on all that stands before, which lambdas over token arrays take quadratic time for; so this is an Arrow function with one dictionary
    per text.
    """

    @F.pandas_udf("string")
    def shape(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            names: dict[str, str] = {}
            out.append(None if t is None else " ".join(names.setdefault(point, f"P{len(names)}") if point else other for point, other in _TOKENS.findall(t)))
        return pd.Series(out, dtype=object)

    return shape(text.cast("string"))


def folded(text: Column) -> Column:
    """Lower case, each run of white space one space."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def clause_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), lambda c: F.trim(c)), lambda c: c != "")


def construction_names(target: Column) -> Column:
    """First word of each construction right of `=`, in order, with repeats."""
    right = F.transform(clause_list(target), lambda c: F.split(F.trim(F.substring_index(c, "=", -1)), ","))
    return F.filter(F.transform(F.flatten(right), lambda c: F.get(F.split(F.trim(c), SPACES), F.lit(0))), lambda n: n != "")


def family(names: Column, distinct: bool = False) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(names) if distinct else names), "+")


def goal_predicate(goal: Column) -> Column:
    return F.get(F.split(F.trim(goal), SPACES), F.lit(0))


def spaced_formal(text: Column) -> Column:
    """Blanks around = , ; ? and single blanks elsewhere."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"([=,;?])", " $1 "), SPACES, " "))


def completion(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def first_segment(text: Column) -> Column:
    """Up to the first `;`, which belongs to it; the whole text if there is none."""
    return F.regexp_extract(text, r"(?s)^[^;]*;?", 0)


def row_text(text: Column, prompt: Column, target: Column) -> Column:
    """The text, or prompt and target where it is null or empty."""
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.trim(F.concat_ws(" ", prompt, target)))


def proof_text(steps: Column) -> Column:
    """`premises => conclusions ; ... ;` of an array of steps."""
    one = F.transform(steps, lambda s: F.concat(F.array_join(s["premises"], " , "), F.lit(" => "), F.array_join(s["conclusions"], " , ")))
    return F.when(F.size(steps) > 0, F.concat(F.array_join(one, " ; "), F.lit(" ;"))).otherwise(F.lit(""))


def insert_before_goal(statement: Column, clause: Column) -> Column:
    parts = F.split(statement, r" \? ")
    return F.concat(F.get(parts, F.lit(0)), F.lit("; "), clause, F.lit(" ? "), F.get(parts, F.lit(1)))


def useful_goal(name: Column, args: Column) -> Column:
    """False for parallels through a common point, and for a segment related to itself."""
    first, second = F.array_sort(F.slice(args, 1, 2)), F.array_sort(F.slice(args, 3, 2))
    four = F.size(args) == 4
    return F.when((name == "para") & four, ~F.arrays_overlap(first, second)).when(name.isin("cong", "perp") & four, first != second).otherwise(True)


def within_limits(groups: Column, predicates: Column, many_groups: bool, most_predicates: int) -> Column:
    """The reason for which a target is rejected, or null."""
    reason = F.lit(None).cast("string")
    if most_predicates >= 0:
        reason = F.when(predicates > most_predicates, "too_many_predicates").otherwise(reason)
    return reason if many_groups else F.when(groups != 1, "multi_target").otherwise(reason)


#: Arguments of a predicate, and of which parts of them (first, length) at least how many must differ.
GRAMMAR = {
    "perp": (4, [((1, 2), 2), ((3, 2), 2)]),
    "para": (4, [((1, 4), 4)]),
    "cong": (4, [((1, 2), 2), ((3, 2), 2)]),
    "coll": (3, [((1, 3), 3)]),
    "cyclic": (4, [((1, 4), 4)]),
    "eqangle": (8, [((1, 4), 3), ((5, 4), 3)]),
}


def valid_args(name: Column, args: Column) -> Column:
    """Whether a predicate has as many and as different arguments as it needs; predicates without a rule pass."""
    out = F.lit(True)
    for known, (count, parts) in GRAMMAR.items():
        fits = F.size(args) == count
        for (first, length), least in parts:
            fits = fits & (F.size(F.array_distinct(F.slice(args, first, length))) >= least)
        out = F.when(name == known, fits).otherwise(out)
    return out


def proof_prompt(premises: Column, goal: Column) -> Column:
    """`{S} premises ? goal {P}`."""
    return F.concat_ws(" ", F.lit("{S}"), premises, F.lit("?"), goal, F.lit("{P}"))


def pretraining_text(premises: Column, goal: Column, proof: Column, construction: Column | None = None) -> Column:
    """Prompt and proof as one text, after the construction's statement where that is given."""
    before = [F.lit("{C}"), construction] if construction is not None else []
    return F.concat_ws(" ", *before, proof_prompt(premises, goal), proof, F.lit("{QED}"))
