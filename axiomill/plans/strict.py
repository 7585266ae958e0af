"""Which rows need their addition: the goal follows with the target's clauses and not without, in repeated diagrams, with the fewest clauses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomill.operators.corpus import combine_votes
from axiomill.plans.prove import prove
from axiomill.plans.staging import staged
from axiomill.sources.statements import Definition, clause, statement

READ = "key string, id string, visible string, target string, head string, goal string, clauses array<string>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Head, goal and clauses of each row; without clauses where a text can't be read."""
    for pdf in batches:
        out = []
        for key, id_, visible, target in pdf[["key", "id", "visible", "target"]].itertuples(index=False):
            head = goal = parts = None
            try:
                asked = statement(visible).goal
                added = [clause(c) for c in target.split(";") if c.strip()]
                if asked and added and all(c.points and c.constructions for c in added):
                    head, goal, parts = visible.partition("?")[0].strip(), " ".join((asked[0], *asked[1])), [c.text() for c in added]
            except (ValueError, AttributeError):
                pass
            out.append((key, id_, visible, target, head, goal, parts))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")])


def _outcomes(spark: SparkSession, statements: DataFrame, repeats: int, visible: bool, defs, most_levels: int, how: dict) -> DataFrame:
    """(problem_id, outcome): the attempts' outcomes taken together; each attempt draws another diagram."""
    tried = statements.select("problem_id", "statement", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("attempt"))
    asked = tried.select(F.concat_ws(":", "attempt", "problem_id").alias("problem_id"), "statement", F.when(F.col("attempt") > 0, F.col("attempt").cast("string")).otherwise("").alias("seed"))
    got = prove(spark, asked, defs, most_levels=most_levels, **how)
    by = got.groupBy(F.split("problem_id", ":", 2)[1].alias("problem_id")).agg(F.collect_list("status").alias("outcomes"))
    return by.select("problem_id", combine_votes(F.col("outcomes"), visible).alias("outcome"))


def _with(chosen: str) -> Column:
    """The statement of the head and of the clauses at the chosen places."""
    return F.expr(f"concat(concat_ws('; ', nullif(head, ''), array_join(transform({chosen}, i -> clauses[i]), '; ')), ' ? ', goal)")


def strict_filter(spark: SparkSession, rows: DataFrame, defs: dict[str, Definition] | None = None, most_levels: int = 6, repeats: int = 1, minimised: str = "none", most_exact: int = 4, **how) -> DataFrame:
    """(id, category, target, minimisation, clauses_before, clauses_after, statement) of rows (id, visible, target), one for each different row.

    category: aux_required where the goal follows with the target's clauses and not without; parse_error where a text is null or can't be
    read, or a goal or an addition is missing; else what kept the row out: visible_solved, visible_timeout, visible_error, auxiliary_timeout,
    auxiliary_error, restored_failed. The last five columns are null but for aux_required. Without the addition one success of `repeats`
    attempts decides, with it all must succeed.

    minimised: `exact` takes the smallest part of the target that is enough (the first by place among equals) for targets of up to most_exact
    clauses and, like `greedy`, drops single clauses from the front again and again for longer ones. All parts of all rows are proved in one run.
    """
    if minimised not in ("none", "exact", "greedy"):
        raise ValueError(f"no such minimisation: {minimised}")
    texts = rows.select(*(F.col(c).cast("string").alias(c) for c in ("id", "visible", "target"))).distinct()
    keyed = texts.withColumn("key", F.sha2(F.to_json(F.struct("id", "visible", "target")), 256))
    read = staged(keyed.mapInPandas(_read, READ), "rows")
    fit = read.where("clauses is not null")
    every = F.expr("sequence(0, size(clauses) - 1)")

    alone = staged(_outcomes(spark, fit.select(F.col("key").alias("problem_id"), F.concat("head", F.lit(" ? "), "goal").alias("statement")), repeats, True, defs, most_levels, how), "alone")
    open_ = fit.join(alone.where("outcome = 'unsolved'").select(F.col("problem_id").alias("key")), "key", "left_semi").withColumn("chosen", every)
    helped = staged(_outcomes(spark, open_.select(F.col("key").alias("problem_id"), _with("chosen").alias("statement")), repeats, False, defs, most_levels, how), "helped")

    solved = open_.join(helped.where("outcome = 'solved'").select(F.col("problem_id").alias("key")), "key", "left_semi")
    best = staged(_fewest(spark, solved, repeats, minimised, most_exact, defs, most_levels, how), "fewest")

    a, h = alone.select(F.col("problem_id").alias("key"), F.col("outcome").alias("a")), helped.select(F.col("problem_id").alias("key"), F.col("outcome").alias("h"))
    category = (
        F.when(F.col("clauses").isNull(), "parse_error")
        .when(F.col("a") != "unsolved", F.concat(F.lit("visible_"), "a"))
        .when(F.col("h").isin("timeout", "error"), F.concat(F.lit("auxiliary_"), "h"))
        .when(F.col("h") == "unsolved", "restored_failed")
        .otherwise("aux_required")
    )
    out = read.join(a, "key", "left").join(h, "key", "left").join(best, "key", "left")
    kept = lambda x: F.when(F.col("chosen").isNotNull(), x)
    return out.select(
        "id",
        category.alias("category"),
        F.expr("array_join(transform(chosen, i -> clauses[i]), '; ')").alias("target"),
        "minimisation",
        kept(F.size("clauses")).alias("clauses_before"),
        kept(F.size("chosen")).alias("clauses_after"),
        kept(_with("chosen")).alias("statement"),
    )


def _fewest(spark: SparkSession, solved: DataFrame, repeats: int, minimised: str, most_exact: int, defs, most_levels: int, how: dict) -> DataFrame:
    """(key, chosen, minimisation): places of the clauses kept."""
    size = F.size("clauses")
    way = F.when(size < 2, "none").when((F.lit(minimised) == "exact") & (size <= most_exact), "exact").otherwise("none" if minimised == "none" else "greedy")
    now = staged(solved.select("key", "head", "goal", "clauses", "chosen", way.alias("minimisation")), "open")
    done = [now.where("minimisation = 'none'").select("key", "chosen", "minimisation")]

    def enough(parts: DataFrame) -> DataFrame:
        """The parts from which the goal follows."""
        named = parts.withColumn("part", F.concat_ws(":", "key", F.array_join(F.col("tried").cast("array<string>"), ",")))
        got = _outcomes(spark, named.select(F.col("part").alias("problem_id"), _with("tried").alias("statement")), repeats, False, defs, most_levels, how)
        return named.join(got.where("outcome = 'solved'").select(F.col("problem_id").alias("part")), "part", "left_semi")

    exact = now.where("minimisation = 'exact'")
    if not exact.isEmpty():
        masks = "sequence(1, shiftleft(1, size(clauses)) - 2)"
        parts = exact.withColumn("tried", F.explode(F.expr(f"transform({masks}, m -> filter(sequence(0, size(clauses) - 1), i -> (shiftright(m, i) & 1) = 1))")))
        first = enough(staged(parts, "parts")).groupBy("key").agg(F.min(F.struct(F.size("tried").alias("n"), F.col("tried").alias("at"))).alias("m"))
        done.append(exact.join(first, "key", "left").select("key", F.coalesce("m.at", "chosen").alias("chosen"), "minimisation"))

    greedy = now.where("minimisation = 'greedy'")
    while not greedy.isEmpty():  # a round drops one clause of each row or ends it, so there are no more rounds than clauses
        done.append(greedy.where("size(chosen) < 2").select("key", "chosen", "minimisation"))
        more = greedy.where("size(chosen) > 1")
        parts = more.select("*", F.posexplode("chosen").alias("place", "out")).withColumn("tried", F.expr("filter(chosen, i -> i <> out)"))
        place = F.row_number().over(Window.partitionBy("key").orderBy("place"))
        left = enough(staged(parts, "parts")).withColumn("n", place).where("n = 1").select("key", F.col("tried").alias("smaller"))
        round_ = staged(more.join(left, "key", "left"), "round")
        done.append(round_.where("smaller is null").select("key", "chosen", "minimisation"))
        greedy = round_.where("smaller is not null").select("key", "head", "goal", "clauses", F.col("smaller").alias("chosen"), "minimisation")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
