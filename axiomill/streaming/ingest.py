"""Shard folders as streams: new files are merged as they come, duplicates of what was seen before are dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomill.plans.staging import shared_dir


def file_stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", name_filter: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder; its checkpoint plays the part of done-markers."""
    reader = spark.readStream.schema(schema).format(kind)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def drain(stream: DataFrame, label: str, checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Run the stream over all that is there now, append its rows to a table in the shared folder, and read that table.

    With checkpoint and target given, a later call goes on where this one ended.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/axiomill-stream-{label}-{uuid.uuid4().hex}"
    target = target or f"{base}/rows"
    job = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).start(target)
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def first_seen(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str | None = None) -> DataFrame:
    """Rows whose key was not seen before. With event_time and late the keys are kept that long; else for ever."""
    if event_time and late:
        return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def merge_batches(stream: DataFrame, merge, checkpoint: str) -> None:
    """Hand every micro-batch to merge(batch, number); a number that comes again after a failure is the same batch."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_into(target: str, key: str):
    """A merge function that appends the rows of a batch whose key the target lacks; safe to repeat."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            old = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(target).where(F.col("_metadata.file_path").contains(f"/batch-{number}/") == F.lit(False))
            rows = rows.join(old.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch-{number}")

    return merge
