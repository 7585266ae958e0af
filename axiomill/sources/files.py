"""Readers and writers of corpus files: JSON lines, text, shards, manifests, dead letters, reports."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.window import Window

CORRUPT = "_corrupt_record"
SLICE = 8 << 20


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str, strict: bool = True, partition_name: str | None = None) -> DataFrame:
    """Rows of JSON-lines files (gzip by suffix), with `source_file` and, where partition_name is given, the number in `<name>_<n>/` of the path.

    strict: a bad line fails the read. Else bad lines stay as rows whose _corrupt_record is set, so they can be counted.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    full = schema if strict else StructType([*schema.fields]).add(CORRUPT, StringType())
    df = spark.read.schema(full).json(paths, mode="FAILFAST" if strict else "PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    df = df.withColumn("source_file", F.col("_metadata.file_path"))
    if partition_name:
        df = df.withColumn("worker", F.regexp_extract("source_file", rf"{re.escape(partition_name)}_(\d+)", 1).cast("int"))
    return df


def good_and_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).select("source_file", CORRUPT)


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, line, value): every line with its number from 1 in its file.

    Lines are counted inside the blocks that files are read in, and the counts of a file's blocks before are added; a file of any size is read in parallel.
    """
    read = spark.read.text(paths).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), "value")
    blocks = read.groupBy("source_file", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("source_file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("source_file").alias("__file"), F.col("__block").alias("__start"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("source_file", "__block").orderBy("__at"))
    rows = read.withColumn("__in", inside).join(blocks, (F.col("source_file") == F.col("__file")) & (F.col("__block") == F.col("__start")))
    return rows.select("source_file", (F.col("__before") + F.col("__in")).alias("line"), "value")


def bad_lines(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """(source_file, line, value) of the non-blank lines that are no JSON of this schema."""
    full = (StructType.fromDDL(schema) if isinstance(schema, str) else StructType([*schema.fields])).add(CORRUPT, StringType())
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return numbered_lines(spark, paths).where(F.trim("value") != "").withColumn("__row", parsed).where(F.col(f"__row.{CORRUPT}").isNotNull()).drop("__row")


def read_jsonl_strictly(spark: SparkSession, paths: str | list[str], schema: StructType | str, **how) -> DataFrame:
    """read_jsonl after a pass that looks for bad lines: ValueError tells the first one's place as path:line."""
    first = bad_lines(spark, paths, schema).orderBy("source_file", "line").first()
    if first:
        raise ValueError(f"{first.source_file}:{first.line}: no JSON of the schema: {first.value[:80]}")
    return read_jsonl(spark, paths, schema, **how)


def read_lines(spark: SparkSession, paths: str | list[str], most: int | None = None) -> DataFrame:
    """Non-blank lines; `most` is a head limit over the files in name order, and in a file by place."""
    df = spark.read.text(paths).where(F.trim("value") != "")
    if most is None:
        return df
    placed = df.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return placed.orderBy("f", "b", "i").limit(most).select("value")


def expand_manifest(spark: SparkSession, path: str) -> list[str]:
    """Paths named in a list file, one to a line, globs as the files they match; # starts a comment; each once, in order."""
    lines = [r.value.partition("#")[0].strip() for r in spark.read.text(path).collect()]
    found = [expand_globs(spark, [x]) if set(x) & set("*?[{") else [x] for x in lines if x]
    return list(dict.fromkeys(x for part in found for x in part))


def expand_globs(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files that match any pattern, each once, sorted; found with Hadoop's file systems, so stores work as well."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), set()
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        for status in path.getFileSystem(conf).globStatus(path) or ():
            found.add(status.getPath().toString())
    return sorted(found)


def shard(files: list[str], index: int, count: int) -> list[str]:
    return files[index::count]


def sorted_json(df: DataFrame) -> DataFrame:
    """One column value: each row as JSON with its keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_jsonl(df: DataFrame, path: str, compressed: bool = False, append: bool = False) -> None:
    sorted_json(df).write.mode("append" if append else "overwrite").option("compression", "gzip" if compressed else "none").text(path)


def write_splits(df: DataFrame, path: str, text: str = "text", split: str = "split") -> None:
    """<path>/jsonl/split=<s>/ and <path>/text/split=<s>/ from the same rows."""
    rows = df.select(split, F.to_json(F.struct(*sorted(c for c in df.columns if c != split))).alias("value"))
    rows.write.mode("overwrite").partitionBy(split).text(f"{path}/jsonl")
    df.select(split, F.regexp_replace(text, r"\s*\n\s*", " ").alias("value")).write.mode("overwrite").partitionBy(split).text(f"{path}/text")


def write_with_rejects(df: DataFrame, reason: Column, path: str, rejects: str) -> DataFrame:
    """Rows without a reason to path, the others with their category to rejects; returns counts by category."""
    marked = df.withColumn("category", reason)
    write_jsonl(marked.where("category is null").drop("category"), path)
    write_jsonl(marked.where("category is not null"), rejects)
    return marked.groupBy(F.coalesce("category", F.lit("kept")).alias("category")).agg(F.count(F.lit(1)).alias("rows"))


def write_stats(stats: DataFrame, path: str) -> None:
    """The one row of stats as a JSON document beside the output it describes."""
    sorted_json(stats.limit(1)).coalesce(1).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, bytes, sha256) of files, those of folders with all that is below; name is the path from the folder on.

    Files are read a slice at a time in a task each, so they may have any size.
    """
    jvm, conf, listed = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for given in [paths] if isinstance(paths, str) else paths:
        root = jvm.org.apache.hadoop.fs.Path(given)
        fs = root.getFileSystem(conf)
        at, top = fs.listFiles(root, True), fs.getFileStatus(root).getPath().toString()
        while at.hasNext():
            status = at.next()
            path = status.getPath().toString()
            listed.append((path, path.removeprefix(top).lstrip("/") or path.rpartition("/")[2], status.getLen()))

    def digest(batches):
        from pyarrow import fs as arrow_fs

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                uri = re.sub(r"^file:/+", "file:///", path)
                store, inner = arrow_fs.FileSystem.from_uri(uri) if ":" in uri else (arrow_fs.LocalFileSystem(), uri)
                total = hashlib.sha256()
                with store.open_input_stream(inner) as f:
                    while part := f.read(SLICE):
                        total.update(part)
                out.append(total.hexdigest())
            yield pdf.assign(sha256=out)

    rows = spark.createDataFrame(listed, "path string, name string, bytes long").repartition(max(1, min(len(listed), 10_000)), "path")
    return rows.mapInPandas(digest, "path string, name string, bytes long, sha256 string")


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, status): MISSING, OK or FAILED by bytes and digest; expected has path (from the manifest's folder on), bytes, sha256."""
    f = found.select(F.col("name").alias("__name"), F.col("bytes").alias("__b"), F.col("sha256").alias("__s"))
    joined = expected.join(f, F.col("path") == F.col("__name"), "left")
    same = (F.col("__b") == F.col("bytes")) & (F.col("__s") == F.col("sha256"))
    return joined.select("path", F.when(F.col("__name").isNull(), "MISSING").when(same, "OK").otherwise("FAILED").alias("status"))


def markdown(df: DataFrame) -> str:
    """A table of a small report."""
    rows = [[str(v) for v in r] for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def missing_workers(found: DataFrame, expected: list[int]) -> DataFrame:
    """Worker numbers that left no file; found has a column worker."""
    return found.sparkSession.createDataFrame([(w,) for w in expected], "worker int").join(found.select("worker").distinct(), "worker", "left_anti")


def summary_document(path: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)
