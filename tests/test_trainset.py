"""Ids against a loop, tail tokens, odd rows, percentiles."""

import os
import tempfile
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.operators import trainset as T
from weft.plans import jobs
from weft.sources import jsonl


def slow(texts, max_len):
    toks = {i: (t or "").split() for i, t in texts}
    count = Counter(w for ws in toks.values() for w in ws)
    ids = {w: k + T.FIRST_ID for k, w in enumerate(sorted(count, key=lambda w: (-count[w], w)))}
    return {i: [ids[w] for w in ws][:max_len] for i, ws in toks.items()}, ids


TEXTS = [(i, " ".join(f"w{k}" for k in np.random.default_rng(i).zipf(1.4, 40) % 300)) for i in range(50)] + [
    (50, None), (51, ""), (52, "once"), (53, "w1 " * 200), (54, "tail1 tail2 tail1 w1")]


@pytest.mark.parametrize("head", [0, 5, 10_000])
def test_ids_for_any_size_of_the_head(spark, head):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "id long, text string, ids string").repartition(3)
    vocab = T.vocabulary(df, "text")
    want, ids = slow(TEXTS, 30)
    assert {r.token: r.token_id for r in vocab.collect()} == ids
    got = {r.id: r for r in T.encode(df, "id", "text", vocab, max_len=30, head=head).collect()}
    assert len(got) == len(TEXTS)
    for i, t in TEXTS:
        r, mine = got[i], want[i]
        assert r.input_ids == r.labels == mine + [T.PAD_ID] * (30 - len(mine)) and r.ids == "x"
        assert r.attention_mask == [1] * len(mine) + [0] * (30 - len(mine))
        assert r.input_content_original == t and r.input_content_original_length == len((t or "").split())
        assert r.input_content_truncated == " ".join((t or "").split()[:30]) and r.input_content_truncated_length == 30


def test_tokens_that_the_vocabulary_lacks(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    vocab = T.vocabulary(df, "text")
    new = spark.createDataFrame([(1, "w1 never never2 w1"), (2, "never")], "id long, text string")
    got = {r.id: r.input_ids for r in T.encode(new, "id", "text", vocab, max_len=5, head=1).collect()}
    assert got == {1: [2, 1, 1, 2, 0], 2: [1, 0, 0, 0, 0]}
    none = T.encode(new, "id", "text", vocab.limit(0), max_len=2).collect()
    assert {tuple(r.input_ids) for r in none} == {(1, 1), (1, 0)}
    assert T.encode(new.limit(0), "id", "text", vocab).collect() == []


def test_training_set_and_monitoring_table(spark):
    drills = spark.createDataFrame([(1, ["a b", "c"], ["d", "e"]), (2, ["a"], []), (3, ["x"], ["y", "z"])],
                                   "conv_id long, turns array<string>, reference array<string>")
    exam = spark.createDataFrame([
        (7, '{"question": "Q", "choices": {"a": "1", "b": "2"}, "answer": {"explanation": "why", "label": "b"}}'),
        (8, '{"question": "Q", "choices": "a) 1", "answer": "a"}'), (9, "not json")], "item_id long, line string")
    got = {r.example_id: r for r in jobs.training_set(drills, exam, max_len=64).collect()}
    assert sorted(got) == ["drill-1-0", "drill-1-1", "exam-7"]
    assert got["exam-7"].input_content_original == (
        "<|im_start|>user\nQ\na) 1\nb) 2<|im_end|>\n<|im_start|>assistant\nwhy คำตอบ: b<|im_end|>\n")
    assert got["drill-1-1"].input_content_original.count("<|im_start|>") == 4
    path = os.path.join(tempfile.mkdtemp(prefix="weft-test-"), "monitor")
    jsonl.write_monitor_csv(spark.createDataFrame(list(got.values())), path)
    back = spark.read.option("header", True).option("multiLine", True).csv(path)
    assert back.count() == 3 and back.columns[1] == "input_content_original_length"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 20)), min_size=1, max_size=60), st.integers(0, 60))
def test_percentiles_of_merged_histograms(spark, rows, cut):
    df = spark.createDataFrame(rows, "g string, n long")
    part = df.withColumn("k", F.monotonically_increasing_id() % 7 < cut % 7)
    h = T.merge_histograms(*(T.length_histogram(part.where(F.col("k") == x), ["g"], "n") for x in (True, False)))
    for r in T.percentiles(h, ["g"], {"p0": 0.01, "p50": 0.5, "p90": 0.9, "p100": 1.0}).collect():
        mine = sorted(n for g, n in rows if g == r.g)
        at = lambda s: mine[max(0, -(-int(s * 100) * len(mine) // 100) - 1)]
        assert (r.n, r.longest, r.p50, r.p100) == (len(mine), mine[-1], at(.5), mine[-1]) and r.p0 == mine[0] and r.p90 == at(.9)


def test_few_files_and_tasks_do_not_hold_the_examples_together(spark):
    """Exam records are rendered, and examples read, by as many tasks as are configured."""
    from weft import session
    from weft.plans.q_mcq import _generated_exam_lines
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sf = tempfile.mkdtemp(prefix="weft-test-")
    spark.range(400).selectExpr("id AS p_partkey", "'large ring' AS p_name", "'Brand#7' AS p_brand", "'SMALL' AS p_type", "cast(id % 50 AS int) AS p_size"
                                ).coalesce(1).write.parquet(f"{sf}/part.parquet")
    lines = _generated_exam_lines(spark, sf)
    assert lines.rdd.getNumPartitions() == n and lines.count() == 400
    drills = spark.createDataFrame([(k, ["a b", "c"], ["d", "e"]) for k in range(100)],
                                   "conv_id long, turns array<string>, reference array<string>").coalesce(1)
    # Odd records of all kinds next to whole ones: only whole ones make examples.
    odd = spark.createDataFrame([(500, None), (501, "null"), (502, "[]"), (503, '{"question": "Q", "choices": null, "answer": {"explanation": "e", "label": "a"}}'),
                                 (504, '{"question": "Q", "choices": "a) 1", "answer": {"explanation": "e"}}')], "item_id long, line string")
    got = jobs.training_set(drills, lines.unionByName(odd).coalesce(1), max_len=64)
    assert got.count() == 200 + sum(k % 3 > 0 for k in range(400))
    written = [p for p in session._SCRATCH if "training-set" in p][-1].removeprefix("file:")
    files = [os.path.join(written, f) for f in os.listdir(written) if f.endswith(".parquet")]
    rows = [spark.read.parquet(f).count() for f in files]
    assert len(files) >= n / 2 and max(rows) <= 6 * sum(rows) / n
