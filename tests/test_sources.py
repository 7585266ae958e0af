"""Files in, files out, streams."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from axiomill.functions.scorer import NgramScorer, length_penalty
from axiomill.sources import files, statements
from axiomill.streaming import ingest


@pytest.fixture
def shards(tmp_path):
    for w in (0, 2):
        folder = tmp_path / "run" / f"part_{w}"
        folder.mkdir(parents=True)
        with gzip.open(folder / "rows.jsonl.gz", "wt") as f:
            f.write('{"id": "a%d", "n": 1}\n{"id": "b%d"}\n' % (w, w) + ("not json\n" if w else ""))
    return str(tmp_path / "run")


def test_jsonl(spark, shards):
    df = files.read_jsonl(spark, f"{shards}/part_*/*.gz", "id string, n int", strict=False, partition_name="part")
    good, bad = files.good_and_bad(df.cache())
    assert sorted((r.id, r.n, r.worker) for r in good.collect()) == [("a0", 1, 0), ("a2", 1, 2), ("b0", None, 0), ("b2", None, 2)] and bad.count() == 1
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        files.read_jsonl(spark, f"{shards}/part_*/*.gz", "id string, n int").collect()
    assert [r.worker for r in files.missing_workers(good, [0, 1, 2]).collect()] == [1]
    assert len(files.expand_globs(spark, [f"{shards}/part_*/*.gz", f"{shards}/part_0/*"])) == 2 and files.shard(["a", "b", "c"], 1, 2) == ["b"]


def test_lists(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# all\na.jsonl\n\nb.jsonl # two\na.jsonl\n")
    assert files.expand_manifest(spark, str(tmp_path / "m.txt")) == ["a.jsonl", "b.jsonl"]
    (tmp_path / "g.txt").write_text(f"{tmp_path}/m.*\nb.jsonl\n")
    assert [p.rpartition("/")[2] for p in files.expand_manifest(spark, str(tmp_path / "g.txt"))] == ["m.txt", "b.jsonl"]
    (tmp_path / "h.txt").write_text("first\n" + "more\n" * 900)
    assert [r.value for r in files.read_lines(spark, [str(tmp_path / "m.txt"), str(tmp_path / "h.txt")], 2).collect()] == ["first", "more"]
    assert files.read_lines(spark, str(tmp_path / "m.txt")).count() == 4 and files.read_lines(spark, str(tmp_path / "m.txt"), 2).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "train"), (2, "y\nz", "val"), (3, None, "train")], "b int, text string, split string")
    files.write_jsonl(df, str(tmp_path / "out"), compressed=True)
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["b"] for x in back) == [1, 2, 3] and list(back[0]) == sorted(back[0])
    files.write_splits(df, str(tmp_path / "s"))
    assert {r.split: r.n for r in spark.read.text(str(tmp_path / "s/text")).groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 2, "val": 1}
    got = {r.category: r.rows for r in files.write_with_rejects(df, F.when(F.col("text").isNull(), "no_text"), str(tmp_path / "k"), str(tmp_path / "r")).collect()}
    assert got == {"kept": 2, "no_text": 1} and "no_text" in spark.read.text(str(tmp_path / "r")).first().value
    files.write_stats(df.agg(F.count("*").alias("rows")), str(tmp_path / "stats"))
    assert files.summary_document(str(tmp_path / "stats"), spark) == {"rows": 3}
    assert files.markdown(df.select("b").orderBy("b").limit(1)) == "| b |\n| --- |\n| 1 |"


def test_verify(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"abd")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.bin").write_bytes(b"abc" * 5_000_000)
    found = files.manifest(spark, str(tmp_path))
    digest = hashlib.sha256(b"abc").hexdigest()
    want = spark.createDataFrame([("a.bin", 3, digest), ("b.bin", 3, digest), ("c.bin", 1, digest), ("sub/b.bin", 15_000_000, hashlib.sha256(b"abc" * 5_000_000).hexdigest())], "path string, bytes long, sha256 string")
    assert {r.path: r.status for r in files.verify(found, want).collect()} == {"a.bin": "OK", "b.bin": "FAILED", "c.bin": "MISSING", "sub/b.bin": "OK"}


def test_statement_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("one\na b = segment a b ? cong a b b a\ntwo\na b c = triangle a b c ? coll a b c\n")
    assert sorted(tuple(r) for r in statements.read_statements(spark, str(tmp_path / "p.txt")).collect()) == [("one", "a b = segment a b ? cong a b b a"), ("two", "a b c = triangle a b c ? coll a b c")]
    (tmp_path / "r.txt").write_text("# rules\nmidp m a b => coll m a b\n\npara a b a c => coll a b c # two\n")
    assert [tuple(r) for r in statements.read_rules(spark, str(tmp_path / "r.txt")).orderBy("rule").collect()] == [("r00", ["midp m a b"], "coll m a b"), ("r01", ["para a b a c"], "coll a b c")]


def test_streams_go_on_where_they_ended(spark, tmp_path):
    put = lambda name, ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "k int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest.drain(ingest.first_seen(ingest.file_stream(spark, str(tmp_path / "in"), "k int, v string"), ["k"]), "t", str(tmp_path / "cp"), str(tmp_path / "out"))
    put("a", [1, 2, 2])
    assert sorted(r.k for r in run().collect()) == [1, 2]
    put("b", [2, 3])
    assert sorted(r.k for r in run().collect()) == [1, 2, 3]
    merge = ingest.merge_into(str(tmp_path / "merged"), "k")
    for number, ids in ((0, [1, 2]), (1, [2, 3, 3]), (1, [2, 3, 3])):  # the last comes twice
        merge(spark.createDataFrame([(i, "x") for i in ids], "k int, v string"), number)
    assert sorted(r.k for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "merged")).collect()) == [1, 2, 3]


def test_scorer(spark):
    df = spark.createDataFrame([("x : C a b ;",), ("x : C a c ;",), ("x : C a b ;",)], "t string")
    got = NgramScorer.fit(df, "t", 3).beam_decode("x :", 2)
    assert [t for t, _ in got] == ["C a b ;", "C a c ;"] and got[0][1] > got[1][1] and length_penalty(1) == 1.0


def test_the_place_of_a_bad_line_is_told(spark, tmp_path):
    lines = [f'{{"a": {i}}}' for i in range(3000)]
    lines[1700], lines[2100] = "{broken", '{"a": "x"}'
    (tmp_path / "one.jsonl").write_text("\n".join(lines[:1000] + [""] + lines[1000:]) + "\n")
    (tmp_path / "two.jsonl").write_text('{"a": 1}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        numbered = files.numbered_lines(spark, str(tmp_path)).where("source_file like '%one%'").collect()
        assert sorted(r.line for r in numbered) == list(range(1, 3002)) and {r.line for r in numbered if r.value == '{"a": 2500}'} == {2502}
        assert sorted(r.line for r in files.bad_lines(spark, str(tmp_path), "a int").collect()) == [1702, 2102]
        with pytest.raises(ValueError, match=r"one\.jsonl:1702: "):
            files.read_jsonl_strictly(spark, str(tmp_path), "a int")
        assert files.read_jsonl_strictly(spark, str(tmp_path / "two.jsonl"), "a int").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
