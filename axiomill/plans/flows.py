"""Whole flows over rows: balanced selection with its counters and metrics, the report of a sweep, the report of what a vocabulary misses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomill.functions.hashing import safe_ratio
from axiomill.operators import select, stats
from axiomill.operators.corpus import first_wins
from axiomill.plans.staging import staged


@dataclass
class Selection:
    """rows: the selected units with their place; counters: one row; metrics: (stage, field, coverage, effective_names, top_four_fraction), before and after."""

    rows: DataFrame
    counters: DataFrame
    metrics: DataFrame


def select_units(rows: DataFrame, order: str, shape: Column, unit: str, unit_shape: Column, family: str, goal: str, names: Column, focus: Column, priority: list[Column], wanted: int, family_cap: int = 0, seen: list[str] | None = None) -> Selection:
    """One flow: rows whose shape an earlier one has are dropped, the others give their units (an array column), units of a known shape are dropped, and
    the rest is selected in turns over families and, within these, goals.

    order: a unique key that says which row is earlier; units of a row come in the order of their array. Within a cell of family and goal units that match the focus come first
    (a preference, so none is rejected for lack of it), then by priority. shape is of a row, the other expressions of a unit: they see all columns of the row, the unit under the name
    `unit`, and its place as unit_at; priority sees the key, unit_at, family, goal and the columns named in `seen`. Only these go with a unit through the flow, so a long row
    is not copied for each of its units; the other columns come back for the selected ones. Rows without units are read and give nothing; a null shape is one shape.
    """
    carried = list(dict.fromkeys([order, family, goal, *(seen or [])]))
    first = staged(first_wins(rows.select(order, shape.alias("__shape")), F.col("__shape"), [order]).select(F.col(order).alias("__first")), "rows")
    kept = rows.join(first, F.col(order).eqNullSafe(F.col("__first")), "left_semi")
    each = kept.select(*[c for c in rows.columns if c != unit], F.posexplode(unit).alias("unit_at", unit))
    digest = F.unhex(F.sha2(F.coalesce(unit_shape.cast("string"), F.lit("")), 256))
    units = each.select(digest.alias("__unit"), F.struct(order, "unit_at", *carried[1:], F.coalesce(focus, F.lit(False)).alias("__focus"), names.alias("__names")).alias("__told"))
    once = units.groupBy("__unit").agg(F.min("__told").alias("__told"), F.count(F.lit(1)).alias("__copies"))
    unique = staged(once.select("__told.*", "__copies"), "unique")
    chosen = staged(select.balanced(unique, family, goal, [F.col("__focus").desc(), *priority], wanted, family_cap), "selected")

    def told(df: DataFrame, stage: str) -> DataFrame:
        fields = [("families", df.select(F.col(family).cast("string").alias("name"))), ("goals", df.select(F.col(goal).cast("string").alias("name"))), ("types", df.select(F.explode("__names").alias("name")))]
        every = fields[0][1].withColumn("field", F.lit("families"))
        for field, some in fields[1:]:
            every = every.unionByName(some.withColumn("field", F.lit(field)))
        return stats.distribution_metrics(every, ["field"], "name").withColumn("stage", F.lit(stage))

    n, focused = F.count(F.lit(1)), F.count_if("__focus")
    tables = [(rows, {"rows_read": n}), (first, {"rows_unique": n}), (unique, {"units": F.sum("__copies"), "units_unique": n, "focus_available": focused}), (chosen, {"selected": n, "focus_selected": focused})]
    counts = [df.agg(*(F.coalesce(value, F.lit(0)).cast("long").alias(name) for name, value in of.items())) for df, of in tables]
    counters = counts[0]
    for more in counts[1:]:
        counters = counters.crossJoin(more)  # single rows
    counters = counters.select("rows_read", "rows_unique", "units", "units_unique", "selected", "focus_available", "focus_selected")
    counters = counters.withColumns({"rows_duplicate": F.col("rows_read") - F.col("rows_unique"), "units_duplicate": F.col("units") - F.col("units_unique")})
    picked = chosen.select(F.col(order).alias("__key"), "unit_at", "place")
    whole = rows.join(F.broadcast(picked), F.col(order).eqNullSafe(F.col("__key")))  # at most `wanted` rows
    whole = whole.select(*[c for c in rows.columns if c != unit], "unit_at", F.get(unit, F.col("unit_at")).alias(unit), "place")
    return Selection(whole, counters, told(unique, "before").unionByName(told(chosen, "after")))


def sweep_report(audits: DataFrame, filters: DataFrame, rows: DataFrame, config: str, expected: int) -> DataFrame:
    """A row for each configuration of a sweep: whether all its workers have finished, CPU hours, and yields per candidate, diagram and CPU hour.

    audits: (config, worker, seconds, diagrams, candidates), a row for each finished generator; filters: (config, worker, seconds) of the filter; rows: (config, worker,
    diagram, target) of what passed. Workers are numbers from 0 to expected - 1. Missing ones are listed. Rates without a denominator are 0; rows without a diagram count as rows only.
    """
    sums = audits.groupBy(config).agg(F.countDistinct("worker").alias("generated"), F.sort_array(F.collect_set("worker")).alias("__audited"), F.sum("seconds").alias("__gen"), F.sum("diagrams").alias("diagrams"), F.sum("candidates").alias("candidates"))
    strict = filters.groupBy(config).agg(F.sort_array(F.collect_set("worker")).alias("__filtered"), F.sum("seconds").alias("__strict"))
    by = rows.groupBy(config, "diagram").agg(F.count(F.lit(1)).alias("__n"))
    some = by.groupBy(config).agg(F.sum("__n").alias("strict_rows"), F.count("diagram").alias("unique_diagrams"), F.max(F.when(F.col("diagram").isNotNull(), F.col("__n"))).alias("__most"))
    targets = rows.groupBy(config).agg(F.countDistinct("target").alias("unique_targets"))
    out = sums.join(strict, config, "left").join(some, config, "left").join(targets, config, "left")
    every = F.transform(F.sequence(F.lit(0), F.lit(expected - 1)), lambda i: i.cast("long"))
    missing = lambda c: F.array_except(every, F.coalesce(F.transform(c, lambda w: w.cast("long")), F.array().cast("array<bigint>")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    hours = (zero("__gen") + zero("__strict")) / 3600
    out = out.withColumns({"missing_generation": missing(F.col("__audited")), "missing_strict": missing(F.col("__filtered")), "strict_rows": zero("strict_rows"), "unique_diagrams": zero("unique_diagrams"), "unique_targets": zero("unique_targets"), "__most": zero("__most")})
    return out.select(
        config, ((F.size("missing_generation") == 0) & (F.size("missing_strict") == 0)).alias("complete"), "missing_generation", "missing_strict", F.round(hours, 4).alias("cpu_hours"), F.round(zero("__gen") / 3600, 4).alias("generator_cpu_hours"),
        "strict_rows", "unique_diagrams", "unique_targets", F.col("__most").alias("max_rows_from_one_diagram"), safe_ratio(F.col("__most"), F.col("strict_rows")).alias("max_diagram_fraction"), safe_ratio(F.col("strict_rows"), F.col("candidates")).alias("keep_fraction"),
        safe_ratio(F.col("strict_rows") * 1000, F.col("diagrams")).alias("rows_per_1000_diagrams"), safe_ratio(F.col("strict_rows"), hours).alias("rows_per_cpu_hour"), safe_ratio(F.col("unique_diagrams"), hours).alias("diagrams_per_cpu_hour"),
    )


def unknown_lines(lines: DataFrame, by: list[str], order: list[str], words: Column, known: DataFrame) -> DataFrame:
    """(by..., order..., pieces, unknown_pieces) for each line that has words: how many of them the vocabulary (a column word) lacks."""
    keyed = lines.select(*by, *order, F.explode(words).alias("word")).where("word <> ''")
    marked = keyed.join(known.select("word", F.lit(1).alias("__known")).distinct(), "word", "left")
    return marked.groupBy(*by, *order).agg(F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("__known").isNull()).alias("unknown_pieces"))


def unknown_report(told: DataFrame, by: list[str]) -> DataFrame:
    """Totals of unknown_lines: lines, pieces, unknown pieces, their fraction (6 digits), and lines with any."""
    lost = F.sum("unknown_pieces")
    return told.groupBy(*by).agg(F.count(F.lit(1)).alias("lines"), F.sum("pieces").alias("pieces"), lost.alias("unknown_pieces"), F.count_if(F.col("unknown_pieces") > 0).alias("lines_with_unknown"), safe_ratio(lost, F.sum("pieces"), 6).alias("unknown_fraction"))


def unknown_examples(told: DataFrame, by: list[str], order: list[str], most: int = 10) -> DataFrame:
    """The first `most` lines of each group that have unknown pieces, in their order."""
    return select.top_k(told.where("unknown_pieces > 0"), by, [F.col(c) for c in order], most).drop("pieces")
