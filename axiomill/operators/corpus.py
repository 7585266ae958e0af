"""Whole-tool corpus operators: merge, dedupe, split, filter, sample, vote, encode."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomill.functions.hashing import stable_fraction
from axiomill.functions.text import canonical_shape
from axiomill.operators.combine import numbered


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key by the order columns.

    The minimum of a struct that starts with the order is taken per key: it combines on the map side, so a key with a
    large share of all rows costs no task more than another. Only the key's digest is shuffled, not the key itself.
    """
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*order, *rest)
    return df.groupBy(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256).alias("__key")).agg(F.min(row).alias("__row")).select(*(F.col(f"__row.{c}").alias(c) for c in df.columns))


def keep_at_least(df: DataFrame, column: str, least: float) -> DataFrame:
    """Rows whose value reaches the least, and rows without one."""
    return df.where(F.col(column).isNull() | (F.col(column) >= least))


def dedupe_key(mode: str, visible: str, target: str) -> Column | None:
    """canonical: up to renaming of points; exact: as written; none: nothing is a duplicate."""
    joined = {"canonical": " | ", "exact": "\0"}.get(mode)
    if mode == "none":
        return None
    if joined is None:
        raise ValueError(f"unknown dedupe mode {mode}")
    both = F.concat_ws(joined, F.coalesce(F.col(visible), F.lit("")), F.coalesce(F.col(target), F.lit("")))
    return canonical_shape(both) if mode == "canonical" else both


def merge(df: DataFrame, mode: str, order: list[str], visible: str, target: str, fraction: str | None = None, least: float = 0.0) -> DataFrame:
    """Fraction filter, then dedupe; first row by order wins."""
    kept = keep_at_least(df, fraction, least) if fraction else df
    key = dedupe_key(mode, visible, target)
    return kept if key is None else first_wins(kept, key, order)


def merge_counters(df: DataFrame, kept: DataFrame, written: DataFrame, corrupt: str | None = None) -> DataFrame:
    """One row: rows_read, rows_bad_json, rows_dropped_low_aux_fraction, rows_duplicate, rows_written."""
    n = F.count(F.lit(1))
    read = df.agg(n.alias("rows_read"), (F.count(corrupt) if corrupt else F.lit(0)).cast("long").alias("rows_bad_json"))
    one = read.crossJoin(kept.agg(n.alias("__kept"))).crossJoin(written.agg(n.alias("rows_written")))  # three single rows
    return one.select("rows_read", "rows_bad_json", (F.col("rows_read") - F.col("rows_bad_json") - F.col("__kept")).alias("rows_dropped_low_aux_fraction"), (F.col("__kept") - F.col("rows_written")).alias("rows_duplicate"), "rows_written")


def split_of(fraction: Column, val: float, test: float) -> Column:
    if val < 0 or test < 0 or val + test >= 1:
        raise ValueError("ratios must be at least 0 and sum to less than 1")
    return F.when(fraction < test, "test").when(fraction < test + val, "val").otherwise("train")


def assign_split(df: DataFrame, key: str, seed: int, val: float, test: float) -> DataFrame:
    """df with a column split; rows with one key share it. A null key counts as the text None, as in the published splits."""
    return df.withColumn("split", split_of(stable_fraction(F.coalesce(F.col(key).cast("string"), F.lit("None")), seed), val, test))


def systematic_indices(total: int, wanted: int, seed: int) -> list[int]:
    """Evenly spread positions with one random phase; every position if all are wanted."""
    if total < 0 or wanted < 0 or wanted > total:
        raise ValueError(f"cannot select {wanted} of {total} rows")
    if wanted == total:
        return list(range(total))
    phase = random.Random(seed).random()
    return [int((i + phase) * total / wanted) for i in range(wanted)]


def systematic_sample(df: DataFrame, order: str, wanted: int, seed: int) -> DataFrame:
    """The rows at the systematic positions of the order column (a unique key of any orderable type), with their position.

    Positions are ranks: rows are dealt by ranges of the key, so clustered keys and texts spread evenly, and ranked inside their range. The
    positions themselves are a table, however many there are.
    """
    total = df.count()
    if total < 0 or wanted < 0 or wanted > total:
        raise ValueError(f"cannot select {wanted} of {total} rows")
    phase = 0.0 if wanted == total else random.Random(seed).random()
    positions = df.sparkSession.range(wanted).select(F.floor((F.col("id") + F.lit(phase)) * total / max(1, wanted)).cast("long").alias("position"))
    return _at(df, order, positions)


def _at(df: DataFrame, order: str, positions: DataFrame) -> DataFrame:
    """Rows at the ranks that positions (position) tell, of a unique key."""
    ranked = numbered(df, [], order, "__position").withColumnRenamed("__position", "position")
    return ranked.join(positions, "position", "left_semi").select("position", *df.columns)


def combine_votes(outcomes: Column, visible: bool) -> Column:
    """The outcome of repeated attempts: of the visible part alone (one success decides), or with the addition (all must succeed)."""
    every = lambda v: F.forall(outcomes, lambda o: o == v)
    some = lambda v: F.exists(outcomes, lambda o: o == v)
    late = F.exists(outcomes, lambda o: o.contains("timeout") | (o == "level_limit"))
    if visible:
        return F.when(some("solved"), "solved").when(every("unsolved"), "unsolved").when(late, "timeout").otherwise("error")
    return F.when(every("solved"), "solved").when(late, "timeout").when(some("error"), "error").otherwise("unsolved")


def masked_example(prompt: Column, target: Column, limit: int) -> tuple[Column, Column]:
    """(input ids, labels): the prompt loses what is too much from its left, the target never; the prompt's labels are -100.

    Null where the target leaves no room for any of the prompt.
    """
    excess = F.size(prompt) + F.size(target) - limit
    kept = F.when(excess <= 0, prompt).when(excess < F.size(prompt), F.slice(prompt, F.greatest(excess, F.lit(0)) + 1, F.greatest(F.size(prompt) - excess, F.lit(0))))
    return F.concat(kept, target), F.concat(F.array_repeat(F.lit(-100), F.size(kept)), target)


def padded(ids: Column, width: Column, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(width - F.size(ids), F.lit(0))))


def pad_width(longest: Column, multiple: int = 8) -> Column:
    return (F.ceil(longest / multiple) * multiple).cast("int")


def completion_rows(df: DataFrame, prompt: str, target: str) -> DataFrame:
    """(prompt, completion, error): trimmed texts; error names the part that is missing or blank."""
    p, t = F.trim(F.coalesce(F.col(prompt), F.lit(""))), F.trim(F.coalesce(F.col(target), F.lit("")))
    return df.select(*[c for c in df.columns if c not in (prompt, target)], p.alias("prompt"), t.alias("completion"), F.when(p == "", "missing_prompt").when(t == "", "missing_target").alias("error"))


def at_positions(df: DataFrame, order: str, positions: list[int]) -> DataFrame:
    """The rows at the given places of the order column (a unique key), with their position."""
    total = df.count()
    wanted = sorted({i for i in positions if 0 <= i < total})
    return _at(df, order, df.sparkSession.createDataFrame([(i,) for i in wanted], "position long"))


def aux_step_fraction(steps: Column, hidden: Column) -> Column:
    """Share of the steps (arrays of facts as text) that name a hidden point; 0 without steps."""
    touched = F.filter(steps, lambda s: F.arrays_overlap(F.split(s, " "), hidden))
    return F.coalesce(F.round(F.try_divide(F.size(touched).cast("double"), F.size(steps).cast("double")), 4), F.lit(0.0))


def learning_rate(step: Column, warmup: int, total: int, peak: float, least: float) -> Column:
    """Linear warm-up, then a cosine down to the least rate."""
    part = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / F.lit(float(warmup))).otherwise(F.lit(least) + F.lit(0.5 * (peak - least)) * (1 + F.cos(F.lit(math.pi) * part)))


def content_digest(df: DataFrame, column: str) -> DataFrame:
    """One row: rows and an order-free digest of a text column (sum of 60-bit parts of the rows' digests)."""
    part = F.conv(F.substring(F.sha2(F.coalesce(F.col(column), F.lit("")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def audited_sample(df: DataFrame, order: str, text: str, wanted: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sample, audit): a systematic sample, and rows and digests of the source and of the sample."""
    sample = systematic_sample(df, order, wanted, seed)
    sides = [content_digest(x, text).select(F.lit(side).alias("side"), "rows", "digest") for side, x in (("source", df), ("sample", sample))]
    return sample, sides[0].union(sides[1])
