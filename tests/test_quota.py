"""Plans by interval against plain loops: quotas, oversampling, batch sizes."""

import pytest
from pyspark.sql import functions as F

from weft.operators import quota

CATS = ["writing", "math", "coding"]


def existing(spark, rows):
    return spark.createDataFrame(rows, "category string, n_existing long")


@pytest.mark.parametrize("rows", [[("writing", 4), ("math", 1), ("other", 9), (None, 2)], []])
def test_planned_quota_is_the_quota_of_that_total(spark, rows):
    ex = existing(spark, rows)
    total = 2 * sum(n for _, n in rows)
    want = quota.remaining_quota(spark, ex, CATS, total).orderBy("ordinal").collect()
    got = quota.planned_quota(ex, CATS, 2).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


@pytest.mark.parametrize("block", [1, 4, 10, 1 << 20])
def test_numbered_makes_every_number_once(spark, block):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 4), ("d", 9), ("e", 57), ("f", None), ("g", -3)], "k string, n long")
    got = quota.numbered(rows, F.col("n"), "i", ["k"], block).collect()
    assert sorted((r.k, r.i) for r in got) == [(k, i) for k, n in (("b", 1), ("c", 4), ("d", 9), ("e", 57)) for i in range(n)]


def test_one_row_with_most_numbers_spans_tasks(spark):
    rows = spark.createDataFrame([("hot", 200_000), ("cold", 3)], "k string, n long")
    got = quota.numbered(rows, F.col("n"), "i", ["k"], 1 << 10)
    per = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in per) == 200_003
    assert max(r["count"] for r in per) < 80_000


def batches(total, low, high):
    out = []
    while total > 0:
        out.append(1 if total <= low else min(high, total))
        total -= out[-1]
    return out


@pytest.mark.parametrize("low,high", [(3, 5), (1, 4), (5, 5), (0, 7)])
def test_batch_plan_takes_the_sizes_of_the_loop(spark, low, high):
    totals = list(range(0, 23))
    q = spark.createDataFrame([(str(t), t) for t in totals], "category string, remaining long")
    got = {}
    for r in quota.batch_plan(q, low, high, block=4).orderBy("batch_id").collect():
        got.setdefault(r.category, []).append(r.n_items)
    assert got == {str(t): batches(t, low, high) for t in totals if t}


def test_oversample_cycles_over_the_sources(spark):
    src = spark.createDataFrame([(i, c) for c, n in (("Writing", 3), ("math", 10), ("none", 2)) for i in range(n)], "id long, category string")
    q = spark.createDataFrame([("writing", 11), ("math", 4), ("coding", 5)], "category string, remaining long")
    got = quota.oversample_plan(src, q, "id", 4, block=1).collect()
    want = [("writing", i, i // 4, i % 3) for i in range(11)] + [("math", i, i // 4, i % 10) for i in range(4)]
    assert sorted(map(tuple, got)) == sorted(want)
