"""Equal differences and constant ratios among all pairs of sparse integer vectors, as classes.

A vector is a map from a name to an integer. Two differences are equal if their non-zero entries are, and in constant ratio if these agree after division by their
greatest common divisor. Pairs are joined within their problem, keys are native expressions, and a class is a group of pairs by key: its links are counted, never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two integers, 0 or more; of 0 and 0 it is 0. Euclid's steps, as many as numbers of that size can take."""
    start = F.struct(F.greatest(F.abs(a), F.abs(b)).alias("a"), F.least(F.abs(a), F.abs(b)).alias("b"))
    most = F.sequence(F.lit(0), F.ceil(F.ln(F.least(F.abs(a), F.abs(b)) + 1) * 2.1).cast("int") + 1)
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(most, start, step, lambda s: s["a"])


def entries(vector: Column) -> Column:
    """The non-zero entries of a vector by name."""
    return F.sort_array(F.map_entries(F.map_filter(vector, lambda k, v: v.isNotNull() & (v != 0))))


def minus(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) - F.coalesce(y, zero))


def _shown(parts: Column) -> Column:
    return F.concat_ws(",", F.transform(parts, lambda e: F.concat(e["key"], F.lit(":"), e["value"])))


def differences(vectors: DataFrame, by: list[str], name: str = "name", vector: str = "vector", const: str = "const") -> DataFrame:
    """(by..., v1, v2, kind, key, unit, times) of every pair of names in a problem.

    The pair is turned so that its difference v1 - v2 begins with a positive entry (equal vectors: v1 < v2). key shows the difference's entries by name, unit the same
    divided by their greatest common divisor, which is times. kind is equal, const (the entry const alone) or difference. Names are one of a kind within a
    problem; a null vector has no entries; problems that are null meet each other.
    """
    # problems are compared as structures, in which nulls are equal; so pairs stay dealt by problem and classes are counted where they are made
    side = lambda n: vectors.select(F.struct(*by).alias(f"by{n}"), F.col(name).alias(f"v{n}"), F.coalesce(F.col(vector).cast("map<string,bigint>"), F.create_map().cast("map<string,bigint>")).alias(f"e{n}"))
    pairs = side(1).join(side(2), (F.col("by1") == F.col("by2")) & (F.col("v1") < F.col("v2"))).withColumn("d", entries(minus(F.col("e1"), F.col("e2"))))
    turned = F.coalesce(F.get("d", F.lit(0))["value"] < 0, F.lit(False))
    d = F.when(turned, F.transform("d", lambda e: F.struct(e["key"].alias("key"), (-e["value"]).alias("value")))).otherwise(F.col("d"))
    pairs = pairs.select(F.col("by1").alias("by"), F.when(turned, F.col("v2")).otherwise(F.col("v1")).alias("v1"), F.when(turned, F.col("v1")).otherwise(F.col("v2")).alias("v2"), d.alias("d"))
    one = F.get("d", F.lit(0))["value"]
    whole = F.aggregate("d", F.lit(0).cast("long"), lambda g, e: F.when(g == 1, g).otherwise(gcd(g, e["value"])))
    times = F.when(F.size("d") == 1, F.abs(one)).when(F.exists("d", lambda e: F.abs(e["value"]) == 1), F.lit(1).cast("long")).otherwise(whole)
    kind = F.when(F.size("d") == 0, "equal").when((F.size("d") == 1) & (F.get("d", F.lit(0))["key"] == const), "const").otherwise("difference")
    pairs = pairs.withColumn("times", times).withColumn("kind", kind)
    unit = F.transform("d", lambda e: F.struct(e["key"].alias("key"), F.call_function("div", e["value"], F.col("times")).alias("value")))
    return pairs.select(*[F.col("by")[c].alias(c) for c in by], "v1", "v2", "kind", _shown(F.col("d")).alias("key"), _shown(unit).alias("unit"), "times")


def equal_differences(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., kind, key, pairs, links, v1, v2): classes of pairs of equal difference, with the smallest pair. links: equalities between the class's pairs."""
    n = F.count(F.lit(1))
    first = F.min(F.struct("v1", "v2"))
    return pairs.groupBy(*by, "kind", "key").agg(n.alias("pairs"), (n * (n - 1) / 2).cast("long").alias("links"), first["v1"].alias("v1"), first["v2"].alias("v2"))


def constant_ratios(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., unit, differences, links, times): classes of different differences in constant ratio; times lists their multiples of the unit, ascending.

    A ratio is told once for each two differences of a class, however many pairs of names have them: links counts these. Classes of one difference, and pairs of equal
    vectors, are left out. A class has at most as many multiples as its problem has pairs.
    """
    made = pairs.where("kind <> 'equal'").groupBy(*by, "unit").agg(F.sort_array(F.collect_set("times")).alias("times"))
    n = F.size("times").cast("long")
    made = made.select(*by, "unit", n.alias("differences"), (n * (n - 1) / 2).cast("long").alias("links"), "times")
    return made.where("differences > 1")
