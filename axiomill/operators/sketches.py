"""Sketches that merge over partitions, and exact answers that they make cheap.

A sketch bounds what has to be looked at: heavy values are counted exactly among the few that can be heavy, pairs among those whose cells are full enough, quantiles inside a
bracket that shrinks to a few per cent each pass. So errors cost time and never change a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomill.plans.staging import staged

#: Spans of rank that a quantile sketch is asked for.
CUTS = 200
#: Cells of a line that are told to all tasks.
MOST_TOLD = 1 << 20


def count_min_cells(keys: list[str], depth: int, width: int) -> Column:
    """The cell of a key in each row of a count-min sketch, as an array of structs (line, cell)."""
    return F.array(*[F.struct(F.lit(i).alias("line"), F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(width)).alias("cell")) for i in range(depth)])


def count_min(df: DataFrame, keys: list[str], depth: int = 4, width: int = 1 << 16) -> DataFrame:
    """(line, cell, n): how many rows fall into each cell. A key's count is at most the least of its cells', which exceeds it by more than e / width of all rows
    with a chance of e^-depth."""
    return df.select(F.explode(count_min_cells(keys, depth, width)).alias("c")).groupBy("c.line", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(*sketches: DataFrame) -> DataFrame:
    """One sketch of the rows of several, of the same depth and width."""
    out = sketches[0]
    for more in sketches[1:]:
        out = out.unionByName(more)
    return out.groupBy("line", "cell").agg(F.sum("n").alias("n"))


def at_most(df: DataFrame, keys: list[str], sketch: DataFrame, depth: int = 4, width: int = 1 << 16) -> DataFrame:
    """(keys..., most) for each different key of df: what its count is at most; a missing cell is 0."""
    cells = df.select(*keys).distinct().select(*keys, F.explode(count_min_cells(keys, depth, width)).alias("c")).select(*keys, "c.line", "c.cell")
    return cells.join(sketch, ["line", "cell"], "left").groupBy(*keys).agg(F.min(F.coalesce("n", F.lit(0))).alias("most"))


def frequent_keys(df: DataFrame, keys: list[str], least: int, depth: int = 2, width: int = 1 << 20) -> DataFrame:
    """(keys..., n) of all keys with at least `least` rows, exactly.

    Rows whose key has a cell below `least` are dropped before anything is sent to count them; that needs one pass more over df and a sketch of width cells.
    The sketch is joined line by line, so it may be of any size: up to MOST_TOLD cells are told to all tasks, and rows are not sent to meet them. A line of which
    more than half is full tells too few rows apart and is left out; all rows are counted then.
    """
    full = staged(count_min(df, keys, depth, width).where(F.col("n") >= least), "count-min")
    cells = {r.line: r["count"] for r in full.groupBy("line").count().collect()}
    rows = df
    for i in range(depth):
        if cells.get(i, 0) > width // 2:
            continue
        line = full.where(F.col("line") == i).select(F.col("cell").alias("__cell"))
        line = F.broadcast(line) if cells.get(i, 0) <= MOST_TOLD else line
        rows = rows.withColumn("__cell", count_min_cells(keys, depth, width)[i]["cell"]).join(line, "__cell", "left_semi").drop("__cell")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def heavy_values(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by..., value, n) of all values that make up at least this share of their group's rows, exactly; null values are not counted.

    A frequent-items sketch of 16 / share counters holds every such value. What it holds is then counted.
    """
    held = 1 << max(4, math.ceil(math.log2(16 / share)))
    if held > 1 << 16:
        raise ValueError("share is too small for a sketch; see frequent_keys")
    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"), F.expr(f"approx_top_k_estimate(approx_top_k_accumulate(`{value}`, {held}), {held})").alias("top"))
    some = sketch.select(*by, "__all", F.explode("top").alias("t")).where(F.col("t.count") >= F.col("__all") * share)
    some = staged(some.select(*[F.col(c).alias(f"__b_{c}") for c in by], "__all", F.col("t.item").alias("__v")), "heavy")
    on = [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in by]
    n = rows.join(some, [*on, F.col(value) == F.col("__v")]).groupBy(*by, value, "__all").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= F.col("__all") * share).select(*by, value, "n")


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: list[float], most: int = 1 << 20, most_rounds: int = 20) -> DataFrame:
    """(by..., quantile, value): the value of rank ceil(quantile * rows) in its group, exactly; null and not-a-number are left out.

    Quantile sketches, merged over partitions, bracket each rank; the next pass looks at the rows inside the bracket only. Once a bracket holds at most `most` rows
    they are ordered. A bracket that turns out to miss its rank is not taken. Groups may have any size; only brackets of at most `most` rows, or of equal values, are ever ordered in one task.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    keys = [f"__b_{c}" for c in by]
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
    groups = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    state = groups.withColumn("__q", wanted).withColumn("__rank", F.greatest(F.ceil(F.col("__q") * F.col("__n")), F.lit(1)).cast("long"))
    state = staged(state.select(*keys, "__q", "__rank", "__lo", "__hi", F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__inside")), "quantiles")
    inside = lambda s: rows.join(F.broadcast(s) if not by else s, [*on, F.col("__v").between(F.col("__lo"), F.col("__hi"))] if by else F.col("__v").between(F.col("__lo"), F.col("__hi")))
    wide = (F.col("__inside") > most) & (F.col("__lo") < F.col("__hi"))
    for _ in range(most_rounds):
        if state.where(wide).isEmpty():
            break
        near = inside(state.where(wide)).groupBy(*keys, "__q", "__rank", "__lo", "__hi", "__below", "__inside").agg(F.expr("kll_sketch_agg_double(__v, 800)").alias("__s"))
        at = (F.col("__rank") - F.col("__below")) / F.col("__inside")
        cuts = F.call_function("kll_sketch_get_quantile_double", F.col("__s"), F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)]))
        place = lambda i: F.get("__cuts", F.greatest(F.lit(0), F.least(F.lit(CUTS), i.cast("int"))))
        tried = near.withColumn("__cuts", cuts).withColumn("__lo2", place(F.floor(at * CUTS) - 1)).withColumn("__hi2", place(F.ceil(at * CUTS) + 1)).drop("__s", "__cuts")
        counts = inside(tried).groupBy(*tried.columns).agg(F.count_if(F.col("__v") < F.col("__lo2")).alias("__b2"), F.count_if(F.col("__v").between(F.col("__lo2"), F.col("__hi2"))).alias("__n2"))
        good = (F.col("__below") + F.col("__b2") < F.col("__rank")) & (F.col("__rank") <= F.col("__below") + F.col("__b2") + F.col("__n2"))
        new = counts.select(*keys, "__q", "__rank", F.when(good, F.col("__lo2")).otherwise(F.col("__lo")).alias("__lo"), F.when(good, F.col("__hi2")).otherwise(F.col("__hi")).alias("__hi"), F.when(good, F.col("__below") + F.col("__b2")).otherwise(F.col("__below")).alias("__below"), F.when(good, F.col("__n2")).otherwise(F.col("__inside")).alias("__inside"))
        state = staged(state.where(~wide).unionByName(new), "quantiles")
    else:
        raise RuntimeError(f"quantiles did not settle in {most_rounds} passes")
    one = state.where("__lo = __hi").select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], F.col("__q").alias("quantile"), F.col("__lo").alias("value"))
    placed = inside(state.where("__lo < __hi")).withColumn("__at", F.row_number().over(Window.partitionBy(*keys, "__q").orderBy("__v")) + F.col("__below"))
    return one.unionByName(placed.where("__at = __rank").select(*by, F.col("__q").alias("quantile"), F.col("__v").alias("value")))
