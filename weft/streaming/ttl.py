"""Requests that no accepted request of the same key precedes within a TTL.

The rule, in event time: a key's requests are taken in ascending order of time
(equal times: by their text as JSON); a request passes if the last one that
passed is ``ttl`` or more before it, or none did.

A stream brings requests out of order, so a request is decided only when the
watermark (latest time seen less ``delay``) has passed it: until then it waits
in the key's state.  So the rows that pass are the same for any number of files a
trigger and any order of arrival within ``delay``.  What arrives later than that
is dropped and counted by the stream (``numRowsDroppedByWatermark``).

State of a key: the time of its last passed request, and the requests that wait.
One that lies within the TTL of a passed request is dropped at once; the state
goes when the watermark is a TTL past the last passed request.  Calling Python
for each key is what costs most, so keys share state in ``buckets`` by hash: some
tens of live keys in each are right, and the number is part of a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: JSON keeps whole microseconds in this form.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
MICROS_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_STATE = "keys array<string>, lasts array<long>, owners array<string>, times array<long>, rows array<string>"
#: For a few million live keys.
BUCKETS = 1 << 16


def decide(waiting: list[tuple[int, str]], last: int | None, ttl: int, upto: int | None):
    """(passed, still waiting, last passed time) of a key's requests, those later
    than ``upto`` being kept waiting (None: none); times in microseconds."""
    passed, kept = [], []
    for t, row in sorted(waiting):
        if last is not None and t - last < ttl:
            continue
        if upto is not None and t > upto:
            kept.append((t, row))
        else:
            passed.append((t, row))
            last = t
    return passed, kept, last


def _held(state) -> tuple[dict, dict]:
    """(last passed time, waiting requests) by key."""
    keys, lasts, owners, times, rows = state
    waiting: dict = {}
    for k, t, row in zip(owners, times, rows):
        waiting.setdefault(k, []).append((t, row))
    return dict(zip(keys, lasts)), waiting


def _update(ttl: int):
    def update(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = _held(state.get) if state.exists else ({}, {})
        if not state.hasTimedOut:
            for f in frames:
                for k, t, row in zip(f["k"].tolist(), f["t"].tolist(), f["row"].tolist()):
                    # In reach of one that passed, a request can't pass any more.
                    if last.get(k) is None or not 0 <= t - last[k] < ttl:
                        waiting.setdefault(k, []).append((t, row))
        mark = state.getCurrentWatermarkMs()
        out, kept, wake = [], [], None
        for k in {**last, **waiting}:
            passed, left, last_k = decide(waiting.get(k, []), last.get(k), ttl, mark * 1000)
            out += [row for _, row in passed]
            kept += [(k, t, row) for t, row in left]
            if not left and (last_k is None or last_k + ttl <= mark * 1000):
                last.pop(k, None)
                continue
            if last_k is not None:
                last[k] = last_k
            due = left[0][0] if left else last_k + ttl
            wake = due if wake is None else min(wake, due)
        if wake is None:
            if state.exists:
                state.remove()
        else:
            state.update((list(last), list(last.values()), *([x[i] for x in kept] for i in range(3))))
            state.setTimeoutTimestamp(max(mark + 1, -(-wake // 1000)))
        yield pd.DataFrame({"row": out}, dtype="object")
    return update


def _packed(rows: DataFrame, ts: Column) -> DataFrame:
    return rows.select("*", F.unix_micros(ts).alias("_t"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false", "timestampFormat": MICROS, "timestampNTZFormat": MICROS_NTZ}).alias("_row"))


def pass_within_ttl(stream: DataFrame, key: str, ts: str, ttl_seconds: int, delay: str,
                    buckets: int = BUCKETS) -> DataFrame:
    """The streaming rows that pass, all columns.  Rows without a time are no
    requests; a null key is a key."""
    rows = _packed(stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay), F.col(ts))
    text = F.col(key).cast("string")
    passed = (rows.select(F.pmod(F.xxhash64(text), F.lit(buckets)).alias("bucket"), text.alias("k"), F.col("_t").alias("t"),
                          F.col("_row").alias("row"), F.col(ts).alias("ts")).groupBy("bucket")
                  .applyInPandasWithState(_update(ttl_seconds * 1_000_000), "row string", _STATE, "append",
                                          GroupStateTimeout.EventTimeTimeout))
    return passed.select(F.from_json("row", stream.schema, {"timestampFormat": MICROS, "timestampNTZFormat": MICROS_NTZ}).alias("r")).select("r.*")


def still_waiting(spark: SparkSession, ckpt: str, schema, ttl_seconds: int) -> DataFrame:
    """The waiting requests of a stopped stream that pass if no more arrive: read
    from its state, which stays as it is."""
    state = spark.read.format("statestore").load(ckpt).select("value.groupState.*")
    ttl = ttl_seconds * 1_000_000

    def settle(frames):
        for f in frames:
            out = []
            for state in zip(*(f[c] for c in ("keys", "lasts", "owners", "times", "rows"))):
                last, waiting = _held(state)
                for k, rows in waiting.items():
                    out += [row for _, row in decide(rows, last.get(k), ttl, None)[0]]
            yield pd.DataFrame({"row": out}, dtype="object")

    found = state.where(F.size("times") > 0).mapInPandas(settle, "row string")
    return found.select(F.from_json("row", schema, {"timestampFormat": MICROS, "timestampNTZFormat": MICROS_NTZ}).alias("r")).select("r.*")
