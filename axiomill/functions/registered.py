"""The library's functions by name, for queries that are SQL text alone.

Scalar functions are SQL expressions, so they stay inside generated code. The table function takes a partitioned table and works on Arrow batches; of a
partition it holds the run that is still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

SPACES = r"[ \t\n\r\f]+"
#: name(arguments) RETURNS type: expression
SCALAR = {
    "am_fraction": ("key STRING, seed STRING", "DOUBLE", "cast(conv(substring(md5(concat(seed, char(0), key)), 1, 13), 16, 10) AS DOUBLE) / 4503599627370496D"),
    "am_ratio": ("a DOUBLE, b DOUBLE", "DOUBLE", "coalesce(round(try_divide(a, b), 4), 0D)"),
    "am_folded": ("text STRING", "STRING", f"trim(regexp_replace(lower(text), r'{SPACES}', ' '))"),
    "am_words": ("text STRING", "ARRAY<STRING>", f"filter(split(text, r'{SPACES}'), w -> w <> '')"),
    "am_split": ("key STRING, seed STRING, test DOUBLE, valid DOUBLE", "STRING", "CASE WHEN am_fraction(key, seed) < test THEN 'test' WHEN am_fraction(key, seed) < test + valid THEN 'val' ELSE 'train' END"),
}


class Islands:
    """am_islands(TABLE(k, at, label) PARTITION BY k ORDER BY ...): (k, label, first, last, n), a row for each run of equal labels, in the order given.

    k and at are bigint, label is a string; nulls are equal to each other.
    """

    def __init__(self):
        self.open = None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        k, at, label = (rows.column(i) for i in range(3))
        n = len(rows)
        if not n:
            return
        same = pc.equal(label.slice(1), label.slice(0, n - 1))
        both = pc.and_(pc.is_null(label.slice(1)), pc.is_null(label.slice(0, n - 1)))
        breaks = pc.invert(pc.or_(pc.fill_null(same, False), both)).to_numpy(zero_copy_only=False).nonzero()[0] + 1
        ends = [*breaks.tolist(), n]
        runs = [(k[lo].as_py(), label[lo].as_py(), at[lo].as_py(), at[hi - 1].as_py(), hi - lo) for lo, hi in zip([0, *breaks.tolist()], ends, strict=True)]
        if self.open:
            key, name, first, _, count = self.open
            if name == runs[0][1]:
                runs[0] = (key, name, first, runs[0][3], count + runs[0][4])
            else:
                runs.insert(0, self.open)
        self.open = runs.pop()
        if runs:
            yield _islands(runs)

    def terminate(self) -> Iterator[pa.Table]:
        if self.open:
            yield _islands([self.open])


def _islands(runs: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*runs, strict=True), kinds, strict=True)], names=["k", "label", "first", "last", "n"])


def register(spark: SparkSession) -> None:
    """Make all functions known to the session's SQL; doing it again changes nothing."""
    for name, (arguments, kind, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("am_islands", arrow_udtf(Islands, returnType="k bigint, label string, first bigint, last bigint, n bigint"))
