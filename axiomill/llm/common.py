"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomill.plans.staging import shared_dir, staged, unstaged

__all__ = ["NO_ID", "NULL_ID", "arrow_batches", "in_order", "ranked", "readable", "shared_dir", "staged", "table", "unstaged"]

#: Stands for a null id wherever ids are compared: nulls come before every other id.
NULL_ID = -(2**63)
#: The same where nulls come after every other id.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readable(column) -> Column:
    """A text column as Python can read it: bytes that are no UTF-8, which Spark lets through, become replacement characters."""
    return F.make_valid_utf8(column.cast("string"))


def in_order(df: DataFrame, part: str, row: str) -> DataFrame | None:
    """df with its rows' own order: that of their files by name and, within a file, of its rows. None for rows that come straight from no file, which have no order."""
    try:
        return df.withColumns({part: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    except AnalysisException:
        return None


@contextmanager
def arrow_batches(spark: SparkSession, records: int):
    """Python workers get at most so many rows at once from what is run inside: for rows that are packed or hold long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(records, int(before)) if int(before) > 0 else records))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, total: int, rows_per_task: int | None = None, place: str | None = None) -> DataFrame:
    """A gapless rank from 0 in column out for the rows of each key, whichever size a key has.

    Each key is dealt over ceil(total / rows_per_task) hash slices of the order columns; by default the slices are about as many
    as the rows in one, as both must fit a task (256 rows at least). Rows are ranked in
    their slice, and the counts of the slices before it are added. So a key with a third of all rows is spread
    over many tasks. The order is by slice, then by the order columns; it depends on the values alone. With a
    column `place` (0 to total - 1) slices are ranges of it, so an order that begins with it holds for all of a key.
    """
    rows_per_task = rows_per_task or max(256, math.isqrt(total))
    slices = max(1, -(-total // rows_per_task))
    cut = f"__{out}_slice"
    slice_of = F.floor(F.col(place) / rows_per_task) if place else F.pmod(F.xxhash64(*order), F.lit(slices))
    dealt = df.withColumn(cut, slice_of.cast("int"))
    if slices == 1:
        w = Window.partitionBy(*keys).orderBy(*order)
        return dealt.withColumn(out, F.row_number().over(w).cast("long") - 1).drop(cut)
    counts = dealt.groupBy(*keys, cut).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    for k in [*keys, cut]:
        counts = counts.withColumnRenamed(k, f"__r_{k}")
    joined = dealt.join(counts, on=[F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in [*keys, cut]], how="inner")
    w = Window.partitionBy(*keys, cut).orderBy(*order)
    joined = joined.withColumn(out, F.row_number().over(w).cast("long") - 1 + F.col("__before"))
    return joined.drop(cut, "__before", *[f"__r_{k}" for k in [*keys, cut]])
