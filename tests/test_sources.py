"""Scans and sinks (S1-S11, S14, S16) with fresh directories."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from weft.sources import jsonl

SCHEMA = "question_id string, category string, turns array<string>"


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="weft-test-")


def _write(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.jsonl"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


GOOD = ['{"question_id": "1", "category": "Writing", "turns": ["สวัสดี", "b"]}',
        '{"question_id": 2, "category": "Math", "turns": ["x"]}']
BAD = ['{"question_id": "3", "category": ', "not json at all"]


def test_tolerant_scan_splits_good_and_bad(spark, tmp):
    p = os.path.join(tmp, "in")
    _write(p, GOOD + [""] + BAD)
    good, bad = jsonl.read_jsonl_tolerant(spark, p, SCHEMA)
    assert good.count() == 2 and bad.count() == 2
    # an int id is read as a string (union of types)
    assert sorted(r.question_id for r in good.collect()) == ["1", "2"]


def test_all_or_nothing_and_strict(spark, tmp):
    p = os.path.join(tmp, "in")
    _write(p, GOOD + BAD)
    assert jsonl.read_jsonl_all_or_nothing(spark, p, SCHEMA).count() == 0
    q = os.path.join(tmp, "ok")
    _write(q, GOOD + [""])
    assert jsonl.read_jsonl_all_or_nothing(spark, q, SCHEMA).count() == 2
    with pytest.raises(Exception):
        jsonl.read_jsonl_strict(spark, p, SCHEMA).collect()


def test_json_array_file(spark, tmp):
    p = os.path.join(tmp, "arr")
    _write(p, ["[" + ", ".join(GOOD) + "]"])
    assert jsonl.read_json_array(spark, p, SCHEMA).count() == 2


def test_named_dataset_prunes_partitions(spark, tmp):
    root = os.path.join(tmp, "ds")
    df = spark.createDataFrame([("onet", "test", "q1"), ("onet", "train", "q2"), ("tgat", "test", "q3")],
                               "subset string, split string, question string")
    df.write.partitionBy("subset", "split").parquet(root)
    sel = jsonl.read_named_dataset(spark, root, subset="onet", split="test")
    assert [r.question for r in sel.collect()] == ["q1"]
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_append_overwrite_roundtrip_keeps_non_ascii(spark, tmp):
    p = os.path.join(tmp, "out")
    df = spark.createDataFrame([("1", "สวัสดี")], "id string, text string")
    jsonl.append_jsonl(df, p)
    jsonl.append_jsonl(df, p)
    assert spark.read.json(p).count() == 2
    jsonl.overwrite_jsonl(df, p)
    back = spark.read.json(p).collect()
    assert len(back) == 1 and back[0].text == "สวัสดี"


def test_verified_write_publishes(spark, tmp):
    p = os.path.join(tmp, "ckpt")
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    assert jsonl.verified_write(df, p) == 1000
    assert spark.read.parquet(p).count() == 1000
    assert jsonl.verified_write(df.limit(10), p) == 10
    assert spark.read.parquet(p).count() == 10


def test_run_partitions_audit_monitor_split(spark, tmp):
    df = spark.createDataFrame([("a", "skipped"), ("b", "failed"), ("c", "failed")],
                               "entry string, status string")
    r1 = jsonl.write_run(df, os.path.join(tmp, "runs"), "20240101_000000")
    r2 = jsonl.write_run(df, os.path.join(tmp, "runs"), "20240102_000000")
    assert r1 != r2 and spark.read.parquet(os.path.join(tmp, "runs")).count() == 6
    jsonl.write_audit(df, os.path.join(tmp, "audit"))
    assert sorted(os.listdir(os.path.join(tmp, "audit")))[-2:] == ["status=failed", "status=skipped"]
    m = spark.createDataFrame([("t", 5, "t", 3)],
                              "original_text string, original_length int, truncated_text string, truncated_length int")
    jsonl.write_monitor_csv(m, os.path.join(tmp, "mon"))
    assert spark.read.option("header", True).csv(os.path.join(tmp, "mon")).columns == \
        ["original_text", "original_length", "truncated_text", "truncated_length"]
    jsonl.publish_split(df, os.path.join(tmp, "pub"))
    assert os.path.isdir(os.path.join(tmp, "pub", "split=test"))


def test_scratch_folders_are_cleared(spark):
    import os

    from weft.session import clear_scratch, scratch_path
    path = scratch_path(spark, "gone")
    spark.range(5).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local) and clear_scratch(spark) >= 1 and not os.path.exists(local)


def test_cluster_needs_a_shared_folder():
    from weft.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
