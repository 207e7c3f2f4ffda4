"""Property tests: quotas sum to the total, explode -> assemble is
the identity, dedup is idempotent and keeps the smallest index, results do
not depend on partitioning, micro-F1 equals accuracy."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.operators import classify, dedup, quota, translate

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(total=st.integers(0, 500), k=st.integers(1, 12))
def test_quota_sums_to_total(spark, total, k):
    cats = [f"c{i}" for i in range(k)]
    ex = spark.createDataFrame([], "category string, n_existing bigint")
    q = quota.remaining_quota(spark, ex, cats, total).collect()
    assert sum(r.remaining for r in q) == total
    assert max(r.target for r in q) - min(r.target for r in q) <= 1


@SETTINGS
@given(rows=st.lists(st.lists(st.text(min_size=0, max_size=6), min_size=0, max_size=4),
                     min_size=1, max_size=6))
def test_explode_assemble_identity(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, turns array<string>")
    units = translate.explode_units(df, "id", ["turns"])
    resp = units.select("id", "field", "pos", F.lit(None).cast("string").alias("error"),
                        F.col("text").alias("content"))
    out = translate.apply_responses(units, resp, ["id", "field", "pos"]) \
                   .withColumn("out_text", F.col("text"))
    got = {r.id: r.turns for r in translate.assemble(df, out, "id", ["turns"]).collect()}
    assert got == dict(enumerate(rows))


@SETTINGS
@given(strs=st.lists(st.sampled_from(["abcdefghij" * 3, "abcdefghij" * 3 + "x", "zzzz", "",
                                      "abcdefghij" * 2 + "abcdefghiq", "hello world"]),
                     min_size=1, max_size=10))
def test_fuzzy_dedup_idempotent_and_keeps_first(spark, strs):
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(strs)), "s": strs}))
    kept, _ = dedup.fuzzy_dedup(df, "s", "id")
    k1 = sorted(r.id for r in kept.collect())
    again, _ = dedup.fuzzy_dedup(df.where(F.col("id").isin(k1)), "s", "id")
    assert sorted(r.id for r in again.collect()) == k1
    assert k1[0] == 0                      # the first row always survives
    shuffled, _ = dedup.fuzzy_dedup(df.repartition(3), "s", "id")
    assert sorted(r.id for r in shuffled.collect()) == k1


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 5)), min_size=1, max_size=40))
def test_micro_f1_equals_accuracy(spark, pairs):
    df = spark.createDataFrame([("s", g, p) for g, p in pairs], "subset string, gold long, pred long")
    r = classify.report(df, by=["subset"]).first()
    assert abs(r.micro_f1 - r.accuracy) < 1e-9
    assert abs(r.accuracy - sum(g == p for g, p in pairs) / len(pairs)) < 1e-6
