"""Several sinks under one manifest, runs that stop, repeated runs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from weft.plans import jobs
from weft.sources.commits import CommitLog
from weft.streaming import jobs as streams


@pytest.fixture()
def log(spark):
    return CommitLog(spark, tempfile.mkdtemp(prefix="weft-log-") + "/log")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_append_replace_and_older_states(spark, log):
    assert log.read("a") is None and log.history() == [] and log.rows("a") == 0
    one = log.commit("r1", {"a": spark.range(3), "b": spark.range(1)})
    log.commit("r2", {"a": spark.range(3, 5).withColumn("note", F.lit("x"))})
    three = log.commit("r3", {"a": spark.range(9, 10)}, replace=("a",))
    assert [c.run_id for c in log.history()] == ["r3", "r2", "r1"]
    assert ids(log.read("a")) == [9] and log.rows("a") == 1 and ids(log.read("b")) == [0]
    two = log.read("a", as_of=one.number + 1)
    assert ids(two) == [0, 1, 2, 3, 4] and two.columns == ["id", "note"] and log.rows("a", as_of=one.number) == 3
    assert three.number == one.number + 2 and log.orphans() == []
    assert ids(CommitLog(spark, log.root).read("a")) == [9]


def test_the_same_run_writes_once(spark, log):
    first = log.commit("r", {"a": spark.range(3)})
    assert log.commit("r", {"a": spark.range(100)}) == first
    assert log.rows("a") == 3 and len(log.history()) == 1


def test_a_run_that_stops_leaves_the_old_state(spark, log):
    log.commit("r1", {"a": spark.range(3)})
    bad = spark.range(4).withColumn("id", F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")))
    with pytest.raises(Exception, match="stop"):
        log.commit("r2", {"b": spark.range(2), "a": bad})
    assert ids(log.read("a")) == [0, 1, 2] and log.read("b") is None
    assert len(log.orphans()) == 1
    log.commit("r2", {"b": spark.range(2), "a": spark.range(3, 4)})
    assert ids(log.read("a")) == [0, 1, 2, 3] and ids(log.read("b")) == [0, 1]


def test_a_cut_off_manifest_counts_as_none(spark, log):
    log.commit("r1", {"a": spark.range(3)})
    with open(os.path.join(log.root, "_commits", "000000000002.json"), "w") as f:
        f.write('{"run_id": "r2", "tables": {')
    assert ids(log.read("a")) == [0, 1, 2] and log.find("r2") is None
    assert log.commit("r2", {"a": spark.range(3, 4)}).number == 3
    assert ids(log.read("a")) == [0, 1, 2, 3]


def test_two_writers_get_two_numbers(spark, log, monkeypatch):
    other = CommitLog(spark, log.root)
    log.commit("r1", {"a": spark.range(1)})
    stale = other._numbers()
    log.commit("r2", {"a": spark.range(1, 2)})
    calls = iter([stale, stale])
    real = other._numbers
    monkeypatch.setattr(other, "_numbers", lambda: next(calls, None) or real())
    assert other.commit("r3", {"a": spark.range(2, 3)}).number == 3
    assert ids(log.read("a")) == [0, 1, 2]


RATE, FILTERED = "Error code: 429 - Rate limit exceeded.", "400 - content_filter: filtered"


def test_translate_run_takes_up_the_rest(spark, log):
    entries = spark.createDataFrame([(1, ["a", "b"], "m"), (2, ["c"], "m"), (3, ["d"], None), (4, ["e", "f"], "m"), (5, [], "m")],
                                    "id long, turns array<string>, meta string")
    answers = [(1, "turns", 0, " A ", None), (1, "turns", 1, "B", None), (2, "turns", 0, None, RATE), (3, "turns", 0, None, FILTERED),
               (4, "turns", 0, "E", None)]
    schema = "id long, field string, pos int, content string, error string"
    late = [*answers, (4, "turns", 1, "F", None), (2, "turns", 0, "never used", None)]
    for run, given in (("r1", answers), ("r1", late), ("r2", late), ("r3", late)):
        jobs.translate_run(log, run, entries, "id", ["turns"], spark.createDataFrame(given, schema))
    out = {r.id: r for r in log.read("output").collect()}
    assert {i: (r.turns, r.status, r.run_id, r.meta) for i, r in out.items()} == {
        1: (["A", "B"], "ok", "r1", "m"), 2: (["c"], "failed", "r1", "m"), 4: (["E", "F"], "ok", "r2", "m"), 5: ([], "ok", "r1", "m")}
    assert [(r.id, r.turns) for r in log.read("skipped").collect()] == [(3, ["d"])]
    f = log.read("failed").collect()
    assert [(r.id, r.pos, r.failed_text, r.error_class, r.run_id) for r in f] == [(2, 0, "c", "Rate Limit (429)", "r1")]
    got = {(r.run_id, r.status): r.n for r in log.read("summary").collect()}
    assert got == {("r1", "ok"): 2, ("r1", "failed"): 1, ("r1", "skipped"): 1, ("r1", "pending"): 1, ("r1", "total"): 5,
                   ("r2", "ok"): 1, ("r2", "total"): 1, ("r3", "total"): 0}


def test_running_totals_are_commits(spark):
    root = tempfile.mkdtemp(prefix="weft-t2-")
    src = streams.stage_json(spark.range(20).select((F.col("id") % 3).alias("g"), "id").repartition(4), "t2")
    kw = dict(out=f"{root}/out", ckpt=f"{root}/ckpt", max_files=1)
    args = (spark, src, "g long, id long", "g", [F.count(F.lit(1)).alias("n")])
    got = streams.running_totals(*args, **kw).collect()
    assert sorted((r.g, r.n) for r in got) == [(0, 7), (1, 7), (2, 6)]
    log = CommitLog(spark, f"{root}/out")
    assert len(log.history()) == 4 and sum(r.n for r in log.read("totals", as_of=2).collect()) < 20
    again = streams.running_totals(*args, **kw)
    assert sorted((r.g, r.n) for r in again.collect()) == [(0, 7), (1, 7), (2, 6)] and len(log.history()) == 4
