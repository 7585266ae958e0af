"""Numeric truth of geometry predicates: column expressions over point structs (x, y)."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances of incidence, of angles and of triangles.
ATOM, ANGLE, TRIANGLE = 1e-12, 1e-11, 1e-9


def cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])


def dot(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (b["x"] - a["x"]) * (d["x"] - c["x"]) + (b["y"] - a["y"]) * (d["y"] - c["y"])


def square(a: Column, b: Column) -> Column:
    return (b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])


def near(a: Column, b: Column, tol: float = ATOM) -> Column:
    return F.abs(a - b) < tol


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def coll(a, b, *rest):
    return _all([F.abs(cross(a, b, a, c)) < ATOM for c in rest])


def ncoll(a, b, *rest):
    return ~coll(a, b, *rest)


def para(a, b, c, d):
    return (F.abs(cross(a, b, c, d)) < ATOM) & ~coll(a, b, c)


def para_or_coll(a, b, c, d):
    return F.abs(cross(a, b, c, d)) < ATOM


def perp(a, b, c, d):
    return F.abs(dot(a, b, c, d)) < ATOM


def cong(a, b, c, d):
    return near(F.sqrt(square(a, b)), F.sqrt(square(c, d)))


def midp(m, a, b):
    return near(2 * m["x"], a["x"] + b["x"]) & near(2 * m["y"], a["y"] + b["y"])


def circle(o, a, *rest):
    return _all([cong(o, a, o, b) for b in rest])


def circumcenter(a: Column, b: Column, c: Column) -> Column:
    d = 2 * cross(a, b, a, c)
    bx, by, cx, cy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - a["x"], c["y"] - a["y"]
    bb, cc = bx * bx + by * by, cx * cx + cy * cy
    return F.struct((a["x"] + F.try_divide(cy * bb - by * cc, d)).alias("x"), (a["y"] + F.try_divide(bx * cc - cx * bb, d)).alias("y"))


def cyclic(a, b, c, *rest):
    """False if the first three points are collinear."""
    o = circumcenter(a, b, c)
    return F.coalesce(~coll(a, b, c) & _all([near(F.sqrt(square(o, a)), F.sqrt(square(o, p)), TRIANGLE) for p in rest]), F.lit(False))


def sameside(b, a, c, y, x, z):
    """b is between a and c exactly if y is between x and z."""
    return (dot(b, a, b, c)) * (dot(y, x, y, z)) > 0


def same_clock(a, b, c, d, e, f):
    return cross(a, b, b, c) * cross(d, e, e, f) > 0


def eqangle(a, b, c, d, e, f, g, h):
    """Directed angles between lines (modulo half a turn) agree: their difference has no sine. Parallel lines make the angle 0."""
    s1, c1, s2, c2 = cross(a, b, c, d), dot(a, b, c, d), cross(e, f, g, h), dot(e, f, g, h)
    n1, n2 = s1 * s1 + c1 * c1, s2 * s2 + c2 * c2
    return (n1 > 0) & (n2 > 0) & (F.abs(F.try_divide(s1 * c2 - c1 * s2, F.sqrt(n1 * n2))) < ANGLE)


def eqratio(a, b, c, d, e, f, g, h):
    return near(F.sqrt(square(a, b) * square(g, h)), F.sqrt(square(c, d) * square(e, f)))


def simtri(a, b, c, x, y, z):
    ab, bc, ca, xy, yz, zx = (F.sqrt(square(p, q)) for p, q in ((a, b), (b, c), (c, a), (x, y), (y, z), (z, x)))
    return near(ab * yz, bc * xy, TRIANGLE) & near(bc * zx, ca * yz, TRIANGLE)


def contri(a, b, c, x, y, z):
    return _all([near(F.sqrt(square(p, q)), F.sqrt(square(r, s)), TRIANGLE) for p, q, r, s in ((a, b, x, y), (b, c, y, z), (c, a, z, x))])


def const_angle(a, b, c, d, m, n):
    """The directed angle from cd to ab is m / n of half a turn, modulo half a turn."""
    s1, c1, turn = cross(c, d, a, b), dot(c, d, a, b), F.lit(math.pi) * m / n
    size = F.sqrt(s1 * s1 + c1 * c1)
    return (size > 0) & (F.abs(F.try_divide(s1 * F.cos(turn) - c1 * F.sin(turn), size)) < ANGLE)


def const_ratio(a, b, c, d, m, n):
    """ab to cd is m to n."""
    return near(F.sqrt(square(a, b)) * n, F.sqrt(square(c, d)) * m)


def _root(v):
    return F.when(v >= 0, F.sqrt(v))


def quadratic(a, b, c):
    """The two roots of a x^2 + b x + c, the one with the negative square root first; null if there are none."""
    root = _root(b * b - 4 * a * c)
    both = F.array(F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a))
    return F.when(F.get(both, F.lit(0)).isNotNull(), both)


def _along(a, b, part):
    return F.struct((a["x"] + part * (b["x"] - a["x"])).alias("x"), (a["y"] + part * (b["y"] - a["y"])).alias("y"))


def line_line(a, b, c, d):
    """The point that lines ab and cd share; null if they are parallel."""
    part = F.try_divide(cross(a, c, c, d), cross(a, b, c, d))
    return F.when(part.isNotNull(), _along(a, b, part))


def _line_circle_parts(a, b, o, r):
    """Where line ab meets the circle, as parts of the way from a to b."""
    return quadratic(square(a, b), 2 * dot(a, b, o, a), square(o, a) - r * r)


def line_circle(a, b, o, r):
    """The two points (they may be one) at which line ab meets the circle around o with radius r, from a's side on; null if it does not."""
    return F.transform(_line_circle_parts(a, b, o, r), lambda part: _along(a, b, part))


def circle_segment(a, b, o, r):
    """Those of them strictly between a and b."""
    inside = F.filter(_line_circle_parts(a, b, o, r), lambda part: (part > 0) & (part < 1))
    return F.transform(F.coalesce(inside, F.array().cast("array<double>")), lambda part: _along(a, b, part))


def circle_circle(o, r, p, s):
    """The two points that circles share, the one to the right of the way from o to p first; null if there are none or the centres are one."""
    way = square(o, p)
    part = F.try_divide(r * r - s * s + way, 2 * way)
    rise = _root(F.try_divide(r * r, way) - part * part)
    at = lambda side: F.struct((o["x"] + part * (p["x"] - o["x"]) + side * rise * (p["y"] - o["y"])).alias("x"), (o["y"] + part * (p["y"] - o["y"]) - side * rise * (p["x"] - o["x"])).alias("y"))
    return F.when(rise.isNotNull() & part.isNotNull(), F.array(at(F.lit(1.0)), at(F.lit(-1.0))))


def rational(most: int = 1_000_000):
    """Pandas UDF double -> (num, den) in lowest terms with a denominator of at most `most`, as near as a double tells; null if there is none."""

    @F.pandas_udf("num long, den long")
    def found(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            near_by = Fraction(v).limit_denominator(most) if math.isfinite(v) else None
            ok = near_by is not None and abs(v * near_by.denominator - near_by.numerator) <= 1e-15 * max(1, abs(near_by.numerator))
            out.append((near_by.numerator, near_by.denominator) if ok else (None, None))
        return pd.DataFrame(out, columns=["num", "den"], dtype="Int64")

    return found


def diff(a, b):
    return ~(near(a["x"], b["x"]) & near(a["y"], b["y"]))


#: The check of each predicate by name, with the number of its points (None: any).
CHECKS: dict[str, tuple[Callable[..., Column], int | None]] = {
    "coll": (coll, None), "ncoll": (ncoll, None), "para": (para, 4), "npara": (lambda *p: ~para_or_coll(*p), 4), "perp": (perp, 4),
    "nperp": (lambda *p: ~perp(*p), 4), "cong": (cong, 4), "midp": (midp, 3), "circle": (circle, 4), "cyclic": (cyclic, None),
    "eqangle": (eqangle, 8), "eqangle6": (eqangle, 8), "eqratio": (eqratio, 8), "eqratio6": (eqratio, 8), "sameside": (sameside, 6),
    "eqratio3": (lambda a, b, c, d, o, p: eqratio(o, a, o, c, o, b, o, d), 6), "simtri": (simtri, 6), "simtri2": (simtri, 6), "simtri*": (simtri, 6), "contri": (contri, 6), "contri2": (contri, 6),
    "contri*": (contri, 6), "diff": (diff, 2),
}


def holds(name: str, *points: Column) -> Column:
    """The predicate's numeric truth; false for an unknown name or a wrong number of points."""
    check, size = CHECKS.get(name, (None, None))
    if check is None or size is not None and len(points) != size:
        return F.lit(False)
    return F.coalesce(check(*points), F.lit(False))
