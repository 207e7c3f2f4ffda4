"""The TTL rule against a loop over sorted requests, for any trigger size
and order of arrival, over restarts, and with late rows."""

import datetime as dt
import random
import tempfile

from hypothesis import given
from hypothesis import strategies as st

from weft.session import scratch_path
from weft.streaming import jobs, ttl

SCHEMA = "id long, key string, ts timestamp, note string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TTL = 3 * 86_400


def slow(rows, seconds=TTL):
    """rows: (id, key, microseconds): ids that pass."""
    last, out = {}, set()
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t - last[k] >= seconds * 10**6:
            last[k] = t
            out.add(i)
    return out


@given(st.lists(st.integers(0, 60), max_size=25, unique=True), st.integers(1, 12), st.integers(0, 25))
def test_decide_in_parts_is_decide_at_once(times, ttl_, cut):
    rows = [(t, str(t)) for t in times]
    whole, none, _ = ttl.decide(rows, None, ttl_, None)
    assert none == [] and [t for t, _ in whole] == sorted(slow([(t, "k", t * 10**6) for t in times], ttl_))
    first, kept, last = ttl.decide(rows, None, ttl_, cut)
    assert first + ttl.decide(kept, last, ttl_, None)[0] == whole


def requests(n, keys, days, seed):
    rnd = random.Random(seed)
    return [(i, rnd.choice(keys), rnd.randrange(days * 86_400 * 10**6)) for i in range(n)]


def arrive(spark, rows, files):
    """Files of rows in the order given."""
    src = scratch_path(spark, "t3-test")
    size = -(-len(rows) // files)
    for k in range(0, len(rows), size):
        part = [(i, key, START + dt.timedelta(microseconds=t), f"n{i}" if i % 2 else None) for i, key, t in rows[k:k + size]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").option("timestampFormat", ttl.MICROS).json(src)
    return src


def run(spark, src, **kw):
    return jobs.dedup_within_ttl(spark, src, SCHEMA, "key", "ts", ttl_seconds=TTL, **kw)


def test_any_trigger_size_and_order_of_arrival(spark):
    rows = requests(400, ["a", "b", "c", None], 30, 4)
    want = slow(rows)
    near = sorted(rows, key=lambda r: r[2] + random.Random(r[0]).random() * 1.9 * 86_400 * 10**6)   # up to two days late
    for files, per_trigger, buckets in ((1, None, 2), (7, 1, 3), (7, 3, 1 << 16)):
        got = run(spark, arrive(spark, near, files), delay="2 days", max_files=per_trigger, buckets=buckets).collect()
        assert sorted(r.id for r in got) == sorted(want)
        assert all(r.ts.microsecond == rows[r.id][2] % 10**6 for r in got)
        assert {r.id: (r.key, r.note) for r in got} == {i: (rows[i][1], f"n{i}" if i % 2 else None) for i in want}


def test_restart_goes_on_where_it_stopped(spark):
    rows = sorted(requests(200, ["a", "b"], 20, 5), key=lambda r: r[2])
    src = arrive(spark, rows[:90], 1)
    root = tempfile.mkdtemp(prefix="weft-ttl-")
    kw = dict(out=f"{root}/out", ckpt=f"{root}/ckpt", delay="1 day")
    assert {r.id for r in run(spark, src, **kw).collect()} == slow(rows[:90])
    part = [(i, k, START + dt.timedelta(microseconds=t), None) for i, k, t in rows[90:]]
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").option("timestampFormat", ttl.MICROS).json(src)
    assert {r.id for r in run(spark, src, **kw).collect()} == slow(rows)
    assert {r.id for r in spark.read.parquet(f"{root}/out").collect()} <= slow(rows)      # decided ones only


def test_boundary_and_state_goes(spark):
    us = 10**6
    rows = [(0, "a", 0), (1, "a", TTL * us - 1), (2, "a", TTL * us), (3, "a", TTL * us), (4, "b", 40 * 86_400 * us)]
    root = tempfile.mkdtemp(prefix="weft-ttl-")
    got = run(spark, arrive(spark, rows, 1), out=f"{root}/out", ckpt=f"{root}/ckpt", delay="1 second")
    assert {r.id for r in got.collect()} == {0, 2, 4}
    held = spark.read.format("statestore").load(f"{root}/ckpt").select("value.groupState.owners").collect()
    assert [r.owners for r in held] == [["b"]]
