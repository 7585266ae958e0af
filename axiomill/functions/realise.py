"""Numeric diagrams: points that satisfy a statement's basic facts, found clause by clause by least squares from seeded starts.

One rule for all constructions: the basic facts of a definition are its equations. A clause with fewer equations than
coordinates leaves its points where the start put them, as near as the equations allow.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

from axiomill.sources.statements import Definition, Statement

TOO_CLOSE, TOO_FAR = 0.1, 4.0


def instance(clause, definitions: dict[str, Definition]) -> list[tuple[list[str], list[tuple[str, list[str]]], list[tuple[str, list[str]]]]]:
    """(points, basic facts, requirements) of a clause's constructions, with its own names."""
    out = []
    for name, args in clause.constructions:
        d = definitions[name]
        given = list(args) if len(args) == len(d.args) else [*clause.points, *args]
        if len(given) != len(d.args):
            raise ValueError(f"Argument mismatch: {name} {' '.join(args)}")
        to = dict(zip(d.args, given, strict=True))
        say = lambda a: [x if x.lstrip("-").isdigit() else to[x] for x in a]  # noqa: B023, E731
        for points, basics in d.basics:
            out.append((say(points), [(n, say(a)) for n, a in basics], [(n, say(a)) for n, a in d.requires]))
    return out


def base_facts(s: Statement, definitions: dict[str, Definition]) -> list[tuple[str, list[str], int]]:
    """(name, args, clause) of all basic facts, constants in their reduced form."""
    out = []
    for i, c in enumerate(s.clauses):
        for _, basics, _ in instance(c, definitions):
            out += [(*normal_basic(n, a), i) for n, a in basics]
    return out


def normal_basic(name: str, args: list[str]) -> tuple[str, list[str]]:
    """Ratios and angles in lowest terms; a negative angle swaps its arms."""
    if name == "rconst" and len(args) == 6:
        g = math.gcd(int(args[4]), int(args[5]))
        return name, [*args[:4], f"{int(args[4]) // g}/{int(args[5]) // g}"]
    if name in ("s_angle", "aconst") and len(args) == 4:
        x, y, z, v = args
        v = int(v)
        if v < 0:
            v, x, z = -v, z, x
        g = math.gcd(v, 180)
        return "aconst", [y, z, y, x, f"{v // g}pi/{180 // g}"]
    return name, list(args)


def _errors(name: str, args: list[str], at) -> list[float]:
    p = [at(a) for a in args if not a[:1].isdigit() and "/" not in a]
    d = [p[i + 1] - p[i] for i in range(0, len(p) - 1, 2)]
    cross = lambda u, v: (u[0] * v[1] - u[1] * v[0]) / (math.hypot(*u) * math.hypot(*v) + 1e-9)
    dot = lambda u, v: (u @ v) / (math.hypot(*u) * math.hypot(*v) + 1e-9)
    size = lambda u: math.hypot(*u)
    if name == "coll":
        return [cross(p[1] - p[0], q - p[0]) for q in p[2:]]
    if name == "para":
        return [cross(d[0], d[1])]
    if name == "perp":
        return [dot(d[0], d[1])]
    if name == "cong":
        return [size(d[0]) - size(d[1])]
    if name == "midp":
        return list(2 * p[0] - p[1] - p[2])
    if name == "circle":
        return [size(p[0] - p[1]) - size(p[0] - q) for q in p[2:]]
    if name == "cyclic":
        return [cross(p[0] - p[2], p[1] - p[2]) * dot(p[0] - q, p[1] - q) - dot(p[0] - p[2], p[1] - p[2]) * cross(p[0] - q, p[1] - q) for q in p[3:]]
    if name in ("eqangle", "eqangle6"):
        s1, c1, s2, c2 = cross(d[0], d[1]), dot(d[0], d[1]), cross(d[2], d[3]), dot(d[2], d[3])
        return [s1 * c2 - c1 * s2]
    if name in ("eqratio", "eqratio6"):
        return [size(d[0]) * size(d[3]) - size(d[1]) * size(d[2])]
    if name == "aconst":
        top, _, low = args[4].partition("pi/")
        t = math.pi * int(top) / int(low)
        return [cross(d[0], d[1]) * math.cos(t) - dot(d[0], d[1]) * math.sin(t)]
    if name == "rconst":
        top, _, low = args[4].partition("/")
        return [size(d[0]) * int(low) - size(d[1]) * int(top)]
    return []


def _solve(errors, start: np.ndarray) -> np.ndarray | None:
    """Gauss-Newton with damping and a numeric Jacobian; None if it doesn't settle at zero."""
    x, damp = start.copy(), 1e-3
    e = np.array(errors(x))
    for _ in range(80):
        if not len(e) or np.abs(e).max() < 1e-13:
            return x
        j = np.empty((len(e), len(x)))
        for k in range(len(x)):
            step = np.zeros(len(x))
            step[k] = 1e-7
            j[:, k] = (np.array(errors(x + step)) - np.array(errors(x - step))) / 2e-7
        move = np.linalg.lstsq(np.vstack([j, math.sqrt(damp) * np.eye(len(x))]), np.concatenate([-e, np.zeros(len(x))]), rcond=None)[0]
        new = np.array(errors(x + move))
        if (new @ new) < (e @ e):
            x, e, damp = x + move, new, damp / 10
        else:
            damp *= 10
            if damp > 1e6:
                break
    return x if len(e) == 0 or np.abs(e).max() < 1e-11 else None


def realise(s: Statement, definitions: dict[str, Definition], seed: str = "", tries: int = 40) -> dict[str, tuple[float, float]] | None:
    """Coordinates of all points, in which the basic facts and (if it has one) the goal hold; None if no try gets there.

    Points too close to each other, or too far out, are drawn again, as is a diagram without what a construction requires. A point defined
    twice is an error.
    """
    points = [p for c in s.clauses for p in c.points]
    if len(points) != len(set(points)):
        raise ValueError("a point is defined twice")
    for attempt in range(tries):
        rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}:{s.text()}:{attempt}".encode(), digest_size=8).digest(), "big"))
        found = _realise_once(s, definitions, rng)
        if found is None:
            continue
        if s.goal is None or holds_at(s.goal[0], list(s.goal[1]), found):
            return {k: (float(v[0]), float(v[1])) for k, v in found.items()}
    return None


def holds_at(name: str, args: list[str], xy: dict) -> bool:
    """Numeric truth of an equation-like fact; false for points that the diagram lacks."""
    if any(a not in xy for a in args if not a[:1].isdigit() and "/" not in a):
        return False
    errors = _errors(name, args, lambda a: np.asarray(xy[a], float))
    return bool(errors) and max(map(abs, errors)) < 1e-7


def meets(name: str, args: list[str], xy: dict) -> bool:
    """Whether the diagram meets a requirement of a construction: an equation, or that one does not hold, or that points differ."""
    if name == "diff":
        return len(set(args)) == len(args)
    if name in ("ncoll", "npara", "nperp"):
        return all(a in xy for a in args) and min(abs(e) for e in _errors(name[1:], args, lambda a: np.asarray(xy[a], float))) > 1e-3
    return holds_at(name, args, xy)


def _realise_once(s: Statement, definitions, rng) -> dict | None:
    xy: dict[str, np.ndarray] = {}
    for c in s.clauses:
        parts = instance(c, definitions)
        facts = [normal_basic(n, a) for _, basics, _ in parts for n, a in basics]
        new = [p for p in c.points if p not in c.at]
        xy |= {p: np.array(v) for p, v in c.at.items()}

        def errors(x, new=new, facts=facts):
            at = lambda a: x[2 * new.index(a) : 2 * new.index(a) + 2] if a in new else xy[a]
            return [e for n, a in facts for e in _errors(n, a, at)]

        for _ in range(25):
            spread = rng.uniform(-1, 1, 2 * len(new)) * 2
            got = _solve(errors, spread) if facts else spread
            if got is None:
                continue
            made = {p: got[2 * i : 2 * i + 2] for i, p in enumerate(new)}
            if _well_placed({**xy, **made}) and all(meets(n, a, {**xy, **made}) for _, _, requires in parts for n, a in requires):
                xy |= made
                break
        else:
            return None
    return xy


def _well_placed(xy: dict) -> bool:
    """No two points too close, none too far from the middle of the others."""
    p = np.array(list(xy.values()))
    if len(p) < 2:
        return True
    gaps = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))[np.triu_indices(len(p), 1)]
    if len(p) == 2:
        return gaps.min() > 0.2
    out = np.hypot(*(p - p.mean(axis=0)).T)
    return gaps.min() > TOO_CLOSE * out.mean() * 0.5 and out.max() < TOO_FAR * (np.median(out) + 1)
