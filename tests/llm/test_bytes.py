"""Texts that are no UTF-8, which Spark and Parquet let through: each operator reads the bad bytes as replacement characters or as they are."""

import pytest
from pyspark.sql import functions as F

from axiomill.llm import ctph, decontamination, lexical_search, mixing, periodic_runs, pii, quality, secrets, sharding, simhash, similar, substring_dedup, toxicity


@pytest.fixture(scope="module")
def broken(spark):
    rows = [(1, "6120622063FF20642065"), (2, "C3"), (3, "6D61696C206D65406578616D706C652E6F7267FE"), (4, None), (5, "6F6B20746578742068657265")]
    df = spark.createDataFrame(rows, "doc_id long, h string")
    return df.select("doc_id", F.unhex("h").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")


def test_every_operator_answers_all_rows(spark, broken, labels):
    bench = broken.select(F.col("doc_id").alias("item_id"), "text")
    made = {
        "pii": pii.scan_personal_data(broken), "secrets": secrets.scan_secrets(broken), "ctph": ctph.fingerprint_documents(broken), "fm": decontamination.decontaminate(broken, bench),
        "shards": sharding.shard_documents(broken), "simhash": simhash.near_duplicates(broken), "substrings": substring_dedup.deduplicate_substrings(broken), "quality": quality.classify_quality(broken, labels),
        "mix": mixing.mix_sources(broken), "similar": similar.similar_documents(broken), "toxicity": toxicity.classify_toxicity(broken, labels), "runs": periodic_runs.periodic_runs(broken),
    }
    for name, df in made.items():
        assert sorted(r.doc_id for r in df.collect()) == [1, 2, 3, 4, 5], name
    assert {r.item_id for r in lexical_search.search(broken, bench).collect()} == {1, 2, 3, 5}
    assert next(r.n_email for r in made["pii"].collect() if r.doc_id == 3) == 1


def test_stages_keep_or_drop_such_rows_like_others(broken, labels, spark):
    bench = spark.createDataFrame([(9, "nothing here")], "item_id long, text string")
    assert decontamination.drop_contaminated(broken, bench).count() == 5
    assert mixing.mixed(broken).count() == 5 and similar.keep_first(broken).count() == 5
    assert quality.drop_low_quality(broken, labels, least=0.0).count() == 5
