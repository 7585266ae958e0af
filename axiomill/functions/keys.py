"""One key for all spellings of a fact, as a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Predicates by the symmetry of their arguments.
SETS = ("coll", "cyclic", "ncoll", "diff", "triangle")
PAIRS = ("npara", "nperp", "para", "cong", "perp", "collx")
CONSTANTS = ("const", "aconst", "rconst")
MIDPOINTS = ("midp", "midpoint")
FOURS = {"eqangle": "eqangle", "eqratio": "eqratio", "eqangle6": "eqangle", "eqratio6": "eqratio"}
TRIANGLES = ("contri", "simtri", "simtri2", "contri2", "contri*", "simtri*")


def _pair(a: Column, i: int) -> Column:
    """Two elements in order, a null last: compared, since sorting an array calls a comparator for each row."""
    two, x, y = F.slice(a, i, 2), F.get(a, F.lit(i - 1)), F.get(a, F.lit(i))
    return F.when((x > y) | (x.isNull() & y.isNotNull()), F.array(y, x)).otherwise(two)


def _ordered(x: Column, y: Column, by_x: Column | None = None, by_y: Column | None = None) -> Column:
    """Two arrays joined, the smaller first; a tie keeps their order."""
    by_x, by_y = (x, y) if by_x is None else (by_x, by_y)
    return F.when(by_x <= by_y, F.concat(x, y)).otherwise(F.concat(y, x))


def _fours(a: Column) -> Column:
    p = [_pair(a, i) for i in (1, 3, 5, 7)]
    swap = F.array_sort(F.concat(p[0], p[2])) > F.array_sort(F.concat(p[1], p[3]))
    left, right = (F.when(swap, F.concat(p[j], p[i])).otherwise(F.concat(p[i], p[j])) for i, j in ((0, 1), (2, 3)))
    return _ordered(left, right)


def _triangles(a: Column) -> Column:
    """Corresponding vertices go together; rows in the order of their sorted pairs, then the two triangles in theirs."""
    cell = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.array_sort(F.array(F.element_at(a, i), F.element_at(a, i + 3))).alias("k"), i.alias("i")))
    order = F.array_sort(cell)
    one = F.transform(order, lambda c: F.element_at(a, c["i"]))
    two = F.transform(order, lambda c: F.element_at(a, c["i"] + 3))
    return _ordered(one, two, F.array_sort(one), F.array_sort(two))


def _ratio3(a: Column) -> Column:
    x = [F.element_at(a, i) for i in range(1, 6)]
    left, right = F.array(x[0], x[2]), F.array(x[1], x[3])
    columns = _ordered(left, right, F.array_sort(left), F.array_sort(right))
    a1, c1, b1, d1 = (F.element_at(columns, i) for i in range(1, 5))
    top, low = F.array(a1, b1), F.array(c1, d1)
    return F.concat(_ordered(top, low, F.array_sort(top), F.array_sort(low)), F.array(x[4], x[4]))


def _forms(args: Column) -> list[tuple[tuple[str, ...], Callable[[], Column]]]:
    """Predicates and the order of their arguments."""
    return [
        (SETS, lambda: F.array_sort(F.array_distinct(args))),
        (PAIRS, lambda: _ordered(_pair(args, 1), _pair(args, 3))),
        (CONSTANTS, lambda: F.concat(_pair(args, 1), _pair(args, 3), F.slice(args, 5, 1))),
        (MIDPOINTS, lambda: F.concat(F.slice(args, 1, 1), _pair(args, 2))),
        (("circle",), lambda: F.concat(F.slice(args, 1, 1), F.array_sort(F.slice(args, 2, 3)))),
        (tuple(FOURS), lambda: _fours(args)),
        (TRIANGLES, lambda: _triangles(args)),
        (("eqratio3",), lambda: _ratio3(args)),
    ]


def canonical_args(name: Column | str, args: Column) -> Column:
    """The one spelling of a fact's arguments. A name known beforehand (a string) keeps the expression small."""
    if isinstance(name, str):
        return next((form() for names, form in _forms(args) if name in names), args)
    first, *others = _forms(args)
    out = F.when(name.isin(*first[0]), first[1]())
    for names, form in others:
        out = out.when(name.isin(*names), form())
    return out.otherwise(args)


def predicate_key(name: Column | str, args: Column) -> Column:
    if isinstance(name, str):
        return F.concat_ws(" ", F.lit(FOURS.get(name, name)), canonical_args(name, args))
    plain = F.when(name == "eqangle6", "eqangle").when(name == "eqratio6", "eqratio").otherwise(name)
    return F.array_join(F.concat(F.array(plain), canonical_args(name, args)), " ")
