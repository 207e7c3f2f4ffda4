"""Driver queries: Structured Streaming jobs over staged files.

Each call stages its input from the driver tables into a fresh directory
under the shared checkpoint root, runs the stream to completion
(``availableNow``) and returns the sink read back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import validate as V
from weft.plans import bindings
from weft.plans.q_usage import _requests
from weft.plans.registry import query
from weft.plans.sqlparts import CALLS, DRILLS, norm_cat, strip_sql
from weft.streaming import jobs

SCRIPT = "english"


def _blank_sql(x: str) -> str:
    return f"({x} IS NULL OR {strip_sql(x)} = '')"


@query("stream_validate", sql=f"""
WITH {DRILLS}
SELECT conv_id, CASE
    WHEN len(reference) <> CASE WHEN lower({norm_cat('category')}) IN ('roleplay', 'humanities', 'writing') THEN 3 ELSE 2 END
      THEN printf('expected %d references, got %d',
                  CASE WHEN lower({norm_cat('category')}) IN ('roleplay', 'humanities', 'writing') THEN 3 ELSE 2 END, len(reference))
    WHEN len(turns) <> 2 THEN printf('expected 2 turns, got %d', len(turns))
    WHEN len(list_filter(turns, lambda x: {_blank_sql('x')})) > 0 THEN 'empty turn'
    WHEN NOT regexp_matches(array_to_string(turns, ' '), '[a-zA-Z]') THEN 'Text does not contain {SCRIPT} characters'
    WHEN length(turns[1]) < 20 THEN 'Turn 1 is too short'
    WHEN length(turns[2]) < 20 THEN 'Turn 2 is too short' END AS reason
FROM drills
""")
def stream_validate(spark, sf):
    """Drills arrive as JSON files; each micro-batch is validated and
    appended (checkpointed, restartable)."""
    src = jobs.stage_json(bindings.drills(spark, sf).drop("system"), "t1-src")
    schema = "conv_id bigint, category string, turns array<string>, reference array<string>"

    def reasons(s):
        r = F.coalesce(V.mtbench_structure_reason(F.col("turns"), F.col("reference"), F.col("category")),
                       V.mtbench_content_reason(F.col("turns"), SCRIPT))
        return s.select("conv_id", r.alias("reason"))
    return jobs.validate_append(spark, src, schema, reasons)


@query("stream_usage", sql=f"""
WITH {CALLS}
SELECT category, count_if(NOT is_cached) AS api_calls, count_if(is_cached) AS cached_calls,
       CAST(coalesce(sum(CASE WHEN NOT is_cached THEN prompt_tokens END), 0) AS BIGINT) AS prompt_tokens,
       CAST(coalesce(sum(CASE WHEN NOT is_cached THEN completion_tokens END), 0) AS BIGINT) AS completion_tokens
FROM calls GROUP BY category
""")
def stream_usage(spark, sf):
    """Running usage totals per category over a stream of call records."""
    src = jobs.stage_json(bindings.calls(spark, sf), "t2-src")
    schema = ("call_id bigint, category string, model string, prompt_tokens bigint, "
              "completion_tokens bigint, is_cached boolean, ts timestamp, total_tokens bigint")
    live = ~F.col("is_cached")
    aggs = [F.count_if(live).alias("api_calls"), F.count_if(F.col("is_cached")).alias("cached_calls"),
            F.coalesce(F.sum(F.when(live, F.col("prompt_tokens"))), F.lit(0)).cast("bigint")
             .alias("prompt_tokens"),
            F.coalesce(F.sum(F.when(live, F.col("completion_tokens"))), F.lit(0)).cast("bigint")
             .alias("completion_tokens")]
    return jobs.running_totals(spark, src, schema, "category", aggs)


TTL_DAYS = 5


@query("stream_dedup", sql=f"""
WITH RECURSIVE req AS (
  SELECT event_id AS call_id, ts, md5('{{"max_tokens": 512, "model": "' || ['gpt-4o-mini', 'gpt-4o', 'gpt-4', 'gpt-3.5-turbo', 'other-model'][user_id % 5 + 1]
         || '", "prompt": "' || replace(replace(event_type || ': ' || props, '\\', '\\\\'), '"', '\\"')
         || '", "temperature": 0.7}}') AS key FROM events),
passed AS (
  SELECT key, min({{'ts': ts, 'call_id': call_id}}) AS p FROM req GROUP BY key
  UNION ALL
  SELECT r.key, min({{'ts': r.ts, 'call_id': r.call_id}}) FROM passed a
  JOIN req r ON r.key = a.key AND r.ts >= a.p.ts + INTERVAL {TTL_DAYS} DAY GROUP BY r.key, a.p)
SELECT p.call_id AS call_id, key, p.ts AS ts FROM passed
""")
def stream_dedup(spark, sf):
    """Requests of which no passed one of the same key lies within the TTL
    before, over a month of calls (several TTLs)."""
    req = _requests(spark, sf).select("call_id", "key", "ts")
    src = jobs.stage_json(req, "t3-src")
    return jobs.dedup_within_ttl(spark, src, "call_id bigint, key string, ts timestamp", "key", "ts",
                                 ttl_seconds=TTL_DAYS * 86_400, buckets=256)
