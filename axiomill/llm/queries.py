"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, each over its whole table.

Where SQL can't tell all columns of an operator (what the method adds, models, xxHash), a companion query `told_...` takes the
operator's result and gives the columns that SQL can tell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ctph import fingerprint_documents
from .decontamination import decontaminate
from .lexical_search import search
from .mixing import mix_sources
from .periodic_runs import implanted, periodic_runs, run_digests
from .pii import scan_personal_data
from .quality import classify_quality
from .secrets import scan_secrets
from .sharding import shard_documents
from .simhash import near_duplicates
from .sql import SQL
from .substring_dedup import deduplicate_substrings
from .toxicity import classify_toxicity
from .url_filter import filter_urls


def op1_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_personal_data(table(spark, sf_dir, "documents"))


def op2_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op6_bfd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)


def op8_pfp_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op9_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("__digest")


def op11_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), rewrite=implanted))


def op13_window_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def told_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii_anchors(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def told_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secret_entropy(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def told_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return op3_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", ruled.alias("ruled"))


def told_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_ctph(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def told_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_bfd_shards(spark, sf_dir).select("doc_id", "size", "law", "grown_shard")


def told_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shard's slots are gapless, and no two shards differ by more bytes than the largest document has."""
    rows = op6_bfd_shards(spark, sf_dir)
    by = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    gapless = F.bool_and((F.col("n") == F.col("slots")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1))
    return by.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), gapless.alias("gapless"), (F.max("bytes") - F.min("bytes") <= F.max("largest")).alias("even"))


def told_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = F.col("score").between(0, 1) & ((F.col("score") >= 0.5) == (F.col("predicted") == 1))
    return op9_mil_quality(spark, sf_dir).select("doc_id", "held_out", sound.alias("sound"))


def told_toxic_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = F.col("score").between(0, 1) & ((F.col("score") >= 0.7) == (F.col("predicted") == 1))
    return op11_counterfactual_toxicity(spark, sf_dir).select("doc_id", "held_out", sound.alias("sound"))


def told_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule's blocks where every source weighs its natural share, as the SQL has it (op10 holds a source that has more than a quarter to that) and a block has 16 rows at any size: their windows, slots and sizes."""
    return mix_sources(table(spark, sf_dir, "documents"), max_share=1.0, block_rows=16).groupBy("source", "block", "release", "deadline", "slot").agg(F.count(F.lit(1)).alias("rows"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith(("op", "told_")) and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
