"""Physical-plan properties the README claims (planning only, no data jobs)."""


import __spark_entry__ as E
from weft.operators import dedup
from tests.conftest import SF01


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_dedup_combines_map_side_and_prunes(spark):
    p = _plan(E.queries()["exact_dedup"](spark, SF01))
    assert "partial_min" in p and "partial_count" in p          # hot keys combined per task
    assert "source" not in p.split("ReadSchema:")[1].split("\n")[0]   # unused column not read


def test_filters_reach_the_scan(spark):
    p = _plan(E.queries()["resume_by_id"](spark, SF01))
    assert "EqualTo(l_linestatus,F)" in p


def test_fuzzy_candidate_join_is_not_broadcast(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    p = _plan(dedup.candidate_pairs(d, "doc_id", "text"))
    assert "BroadcastHashJoin" not in p and "SortMergeJoin" in p      # a hot key can spill


def test_classification_aggregates_before_shuffle(spark):
    p = _plan(E.queries()["cls_report"](spark, SF01))
    assert "partial_count" in p
    assert "l_orderkey" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_history_window_is_keyed_by_conversation(spark):
    p = _plan(E.queries()["chat_history"](spark, SF01))
    assert "Window" in p and "hashpartitioning(conv_id" in p


def test_usage_rollup_single_pass(spark):
    p = _plan(E.queries()["usage_rollup"](spark, SF01))
    assert p.count("FileScan") == 1 and "Expand" in p               # grouping sets in one scan
