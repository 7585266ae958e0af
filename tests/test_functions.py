"""Column functions against plain Python and known literals."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from axiomill.functions import hashing, keys, numeric, render, text
from axiomill.plans.prove import own_definitions
from axiomill.sources.statements import statement


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("a, b", [("p = midpoint p q r | x", "P0 = midpoint P0 P1 r | x"), ("a b = segment a b", "P0 P1 = segment P0 P1"), ("a1 p10 Ab _x", "P0 P1 Ab _x")])
def test_canonical_shape(spark, a, b):
    got = one(spark, text.canonical_shape(F.col("t")), t=a)
    if a.startswith("p ="):
        b = "P0 = midpoint P0 P1 P2 | P3"
    assert got == b


def test_texts(spark):
    assert one(spark, text.construction_names(F.col("t")), t="e = on_line e a c, on_line e b d; f = midpoint f a e") == ["on_line", "on_line", "midpoint"]
    assert one(spark, text.family(F.array(*map(F.lit, "bab"))), x=1) == "a+b+b" and one(spark, text.family(F.array(*map(F.lit, "bab")), distinct=True), x=1) == "a+b"
    assert one(spark, text.spaced_formal(F.col("t")), t="a b=segment a b;c=x c?perp a b") == "a b = segment a b ; c = x c ? perp a b"
    assert one(spark, text.first_segment(F.col("t")), t="a ; b ;") == "a ;" and one(spark, text.first_segment(F.col("t")), t="ab") == "ab"
    assert one(spark, text.row_text(F.lit(""), F.lit("p"), F.lit("t")), x=1) == "p t" and one(spark, text.row_text(F.lit("x"), F.lit("p"), F.lit("t")), x=1) == "x"
    assert one(spark, text.insert_before_goal(F.col("t"), F.lit("e = foot e a b c")), t="a b = segment a b ? perp a b c d") == "a b = segment a b; e = foot e a b c ? perp a b c d"
    assert one(spark, text.goal_predicate(F.col("t")), t=" perp a b c d") == "perp"
    steps = F.array(F.struct(F.array(F.lit("p"), F.lit("q")).alias("premises"), F.array(F.lit("r")).alias("conclusions")))
    assert one(spark, text.proof_text(steps), x=1) == "p , q => r ;"


@pytest.mark.parametrize("name, args, useful", [("para", "a b b c", False), ("para", "a b c d", True), ("cong", "a b b a", False), ("perp", "a b a c", True), ("coll", "a b c", True)])
def test_useful_goals(spark, name, args, useful):
    assert one(spark, text.useful_goal(F.lit(name), F.array(*map(F.lit, args.split()))), x=1) is useful


def test_limits(spark):
    got = lambda g, p, many, most: one(spark, text.within_limits(F.lit(g), F.lit(p), many, most), x=1)
    assert (got(2, 9, False, 5), got(1, 9, False, 5), got(2, 9, True, 5), got(2, 9, True, -1)) == ("multi_target", "too_many_predicates", "too_many_predicates", None)


def test_hashes(spark):
    got = spark.createDataFrame([("k1",), ("",)], "k string").select("k", hashing.stable_fraction(F.col("k"), 7).alias("f"), hashing.stable_fraction_blake(7)("k").alias("b"), hashing.stable_priority(F.col("k"), 7).alias("p")).collect()
    for r in got:
        raw = f"7\0{r.k}".encode()
        assert r.f == int(hashlib.md5(raw).hexdigest()[:13], 16) / 2**52
        assert r.b == int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big") / 2**64
        assert r.p == hashlib.sha256(raw).hexdigest()
    assert hashing.attempt_seed(1, 2) == int.from_bytes(hashlib.blake2b(b"1:2", digest_size=4).digest(), "big")


SPELLINGS = {
    "para": [[0, 1, 2, 3], [1, 0, 2, 3], [2, 3, 0, 1], [3, 2, 1, 0]],
    "midp": [[0, 1, 2], [0, 2, 1]],
    "circle": [[0, 1, 2, 3], [0, 3, 1, 2]],
    "coll": [[0, 1, 2], [2, 0, 1], [1, 0, 2]],
    "eqangle": [[0, 1, 2, 3, 4, 5, 6, 7], [4, 5, 6, 7, 0, 1, 2, 3], [2, 3, 0, 1, 6, 7, 4, 5], [1, 0, 3, 2, 5, 4, 7, 6]],
    "simtri": [[0, 1, 2, 3, 4, 5], [1, 0, 2, 4, 3, 5], [3, 4, 5, 0, 1, 2], [5, 4, 3, 2, 1, 0]],
    "eqratio3": [[0, 1, 2, 3, 4, 4], [1, 0, 3, 2, 4, 4], [2, 3, 0, 1, 4, 4]],
}


def test_all_spellings_have_one_key(spark):
    rng, rows = random.Random(1), []
    for name, forms in SPELLINGS.items():
        for trial in range(6):
            points = rng.sample("abcdefghij", 8)
            rows += [(name, trial, [points[i] for i in f]) for f in forms]
    df = spark.createDataFrame(rows, "name string, trial int, args array<string>")
    got = df.groupBy("name", "trial").agg(F.countDistinct(keys.predicate_key(F.col("name"), F.col("args"))).alias("n"), F.count(F.lit(1)).alias("m")).collect()
    assert all(r.n == 1 for r in got)


def test_column_keys_are_those_of_the_renderer(spark):
    rows = [(n, rng.sample("abcdefgh", 8)[:size]) for rng in [random.Random(2)] for n, size in (("eqangle6", 8), ("eqratio", 8), ("perp", 4), ("cyclic", 4), ("midp", 3), ("circle", 4)) for _ in range(15)]
    for r in spark.createDataFrame(rows, "name string, args array<string>").select("*", keys.predicate_key(F.col("name"), F.col("args")).alias("k")).collect():
        n, a = render.canonical(r.name, r.args)
        assert r.k == " ".join([n, *a])


XY = {"a": (0, 0), "b": (4, 0), "c": (0, 3), "m": (2, 0), "d": (4, 3), "o": (2, 1.5), "h": (0, 0.0), "e": (8, 0), "f": (0, 6)}


@pytest.mark.parametrize(
    "fact, truth",
    [("coll a b m", True), ("coll a b c", False), ("ncoll a b c", True), ("para a b c d", True), ("para a m m b", False), ("perp a b a c", True), ("perp a b b c", False), ("cong o a o b", True), ("cong a b a c", False), ("midp m a b", True), ("midp m a c", False), ("circle o a b c", True), ("cyclic a b c d", True), ("cyclic a b c m", False), ("cyclic a m b c", False), ("eqratio a b a c a e a f", True), ("eqratio a b a c a e a c", False), ("eqangle a b a c b a b d", True), ("eqangle a b a d a c a d", False), ("simtri a b c a e f", True), ("contri a b c d c b", True), ("contri a b c a e f", False), ("sameside m a b o a d", True), ("diff a b", True), ("diff a h", False), ("npara a b a c", True), ("unknown a b", False), ("perp a b", False)],
)
def test_numeric_truth(spark, fact, truth):
    name, *args = fact.split()
    points = [F.struct(F.lit(float(XY[p][0])).alias("x"), F.lit(float(XY[p][1])).alias("y")) for p in args]
    assert one(spark, numeric.holds(name, *points), x=1) is truth


# ---- statement text ------------------------------------------------------------------------------------------------------


def test_prompt_and_target():
    defs = own_definitions()
    p, ref = render.prompt(statement("a b c = triangle a b c; d = on_tline d b a c, on_tline d c a b ? perp a d b c"), defs)
    assert f"{p} x00" == "{S} a : ; b : ; c : ; d : T a b c d 00 T a c b d 01 ? T a d b c {F1} x00"
    got, sizes = render.target("e = on_line e a c, on_line e b d", defs, ref)
    assert got == "e : C a c e 02 C b d e 03 ;" and (sizes["target_groups"], sizes["target_predicates"]) == (1, 2)


def test_actions_follow_each_other():
    got = render.action_sequence(statement("a b c = triangle a b c ? perp a b b c"), "d = midpoint d a b; e = on_line e d c", own_definitions())
    assert [(x["action_index"], x["action_count"]) for x in got] == [(0, 2), (1, 2)]
    assert "d = on_line d a b" in got[1]["visible"] and got[0]["target"] in got[1]["prompt"]


@pytest.mark.parametrize("target, reason", [("d e : C a b d 00 C a c e 01 ;", "multi_point_head"), ("d : C a b d 00 ; e : C d c e 01 ;", None), ("d : C a z d 00 ;", "unknown_point"), ("a : C a b c 00 ;", "known_point"), ("d C a b", "parse_error"), ("d : ;", "no_facts")])
def test_targets_are_rejected_with_a_reason(target, reason):
    assert render.reject_reason(target, {"a", "b", "c"}) == reason


def test_segments_are_ordered_by_what_they_need():
    parts = [(["e"], [("coll", ["d", "c", "e"])]), (["d"], [("coll", ["a", "b", "d"])]), (["x", "y"], [])]
    assert [p[0] for p in render.dependency_order(parts, {"a", "b", "c"})] == [["d"], ["e"], ["x", "y"]]


@pytest.mark.parametrize("fact, said", [("perp x a b c", "on_tline x a b c"), ("perp b x x c", "on_dia x c b"), ("para a b c x", "on_pline x c a b"), ("cong a x x b", "on_bline x b a"), ("cong a b a x", "on_circle x a b"), ("cong x a b c", "eqdistance x a b c"), ("coll a x b", "on_line x a b"), ("cyclic a b x c", "on_circum x a b c"), ("midp x a b", "midpoint x a b")])
def test_facts_become_constructions(fact, said):
    name, *args = fact.split()
    assert render.construction("x", name, args) == said


def test_words():
    assert render.english("perp a d b c") == "AD ⟂ BC" and render.english("midp m a b") == "M is the midpoint of AB"
    assert all(render.english(" ".join([n, *"abcdefgh"[:k]])) for n, k in (("coll", 3), ("cyclic", 4), ("para", 4), ("cong", 4), ("circle", 4), ("eqangle", 8), ("eqratio", 8), ("other", 2)))


def test_pairs_of_items(spark):
    from axiomill.operators import select

    df = spark.createDataFrame([("g", x, i) for i, x in enumerate("wxyz")] + [("h", "q", 0)], "g string, item string, o int")
    for size in (2, 3, 4):
        got = {tuple(r)[1:] for r in select.pairs(df, ["g"], "item", "o", size).collect()}
        assert got == set(itertools.combinations("wxyz", size))
        assert {tuple(r)[1:] for r in select.pairs(df, ["g"], "item", "o", size, ordered=True).collect()} == set(itertools.permutations("wxyz", size))


def point(x, y):
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))


def test_points_of_lines_and_circles(spark):
    rng = random.Random(4)
    for _ in range(12):
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = p = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(4)]
        a, b, c, d = (point(*q) for q in p)
        r, s = rng.uniform(0.5, 4), rng.uniform(0.5, 4)
        on = lambda q: abs((bx - ax) * (q.y - ay) - (by - ay) * (q.x - ax)) < 1e-6  # noqa: B023, E731
        away = lambda q, ox, oy: math.hypot(q.x - ox, q.y - oy)
        got = spark.range(1).select(numeric.line_line(a, b, c, d).alias("ll"), numeric.line_circle(a, b, c, F.lit(r)).alias("lc"), numeric.circle_segment(a, b, c, F.lit(r)).alias("cs"), numeric.circle_circle(c, F.lit(r), d, F.lit(s)).alias("cc")).first()
        assert on(got.ll) and abs((dx - cx) * (got.ll.y - cy) - (dy - cy) * (got.ll.x - cx)) < 1e-6
        reach = abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / math.hypot(bx - ax, by - ay)
        assert (got.lc is not None) == (reach <= r)
        assert all(on(q) and abs(away(q, cx, cy) - r) < 1e-6 for q in got.lc or [])
        between = [q for q in got.lc or [] if min(ax, bx) < q.x < max(ax, bx)]
        assert [(q.x, q.y) for q in got.cs] == [(q.x, q.y) for q in between]
        assert (got.cc is not None) == (abs(r - s) <= math.hypot(dx - cx, dy - cy) <= r + s)
        assert all(abs(away(q, cx, cy) - r) < 1e-6 and abs(away(q, dx, dy) - s) < 1e-6 for q in got.cc or [])
    none = spark.range(1).select(numeric.line_line(point(0, 0), point(1, 1), point(0, 1), point(1, 2)), numeric.circle_circle(point(0, 0), F.lit(1.0), point(0, 0), F.lit(1.0)), numeric.quadratic(F.lit(1.0), F.lit(0.0), F.lit(1.0)), numeric.quadratic(F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()
    assert list(none) == [None] * 4
    assert spark.range(1).select(numeric.quadratic(F.lit(2.0), F.lit(-6.0), F.lit(4.0))).first()[0] == [1.0, 2.0]


def test_constants(spark):
    o, e, n, f = point(0, 0), point(2, 0), point(0, 1), point(1, math.sqrt(3))
    third = lambda m: numeric.const_angle(o, f, o, e, F.lit(m), F.lit(3))
    got = spark.range(1).select(third(1), third(4), third(2), numeric.const_angle(f, o, o, e, F.lit(1), F.lit(3)), numeric.const_angle(o, o, o, e, F.lit(1), F.lit(3)), numeric.const_ratio(o, e, o, n, F.lit(2), F.lit(1)), numeric.const_ratio(o, e, o, n, F.lit(1), F.lit(2))).first()
    assert list(got) == [True, True, False, True, False, True, False]
    values = [0.5, 1 / 3, -22 / 7, 4.0, math.pi, float("nan"), None]
    found = spark.createDataFrame([(v,) for v in values], "v double").select(numeric.rational()("v").alias("q")).collect()
    assert [(r.q.num, r.q.den) for r in found] == [(1, 2), (1, 3), (-22, 7), (4, 1), (None, None), (None, None), (None, None)]


def test_segments_are_told_from_their_common_end():
    for ends in itertools.product("abc", repeat=4):
        if ends[0] != ends[1] and ends[2] != ends[3]:
            got = render.symbolic("eqangle", [*ends, *"wxyz"]).split()[1:5]
            assert {*got[:2]} == {*ends[:2]} and {*got[2:]} == {*ends[2:]} and (got[0] == got[2]) == bool({*ends[:2]} & {*ends[2:]})
    assert render.symbolic("eqratio", list("abcdabab")) == "/ a b c d b a b a"


def test_canonical_shapes(spark):
    texts = ["a b = segment a b; p12 = foot P a 3a a_1 b2x é😀", "", None, "x\ty\nx"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.canonical_shape(F.col("t"))).collect()]
    assert got == ["P0 P1 = segment P0 P1 ; P2 = foot P P0 3 P0 a_1 b2x é 😀", "", None, "P0 P1 P0"]
