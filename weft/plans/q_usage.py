"""Driver queries: usage roll-up, progress, response cache (A3, A4, J5, J8,
P27, F8, W6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import usage
from weft.operators.ordering import cumulative_sum, row_number_within
from weft.plans import bindings
from weft.plans.registry import query
from weft.plans.sqlparts import CALLS, MODELS_ARR
from weft.sources.tables import read_table

TEMPERATURE, MAX_TOKENS = 0.7, 512
CACHE_NOW, CACHE_DAYS = "2024-02-01 00:00:00", 20
PROGRESS_BATCH = 500

_PRICE_CASE = lambda col, i: "CASE model " + " ".join(
    f"WHEN '{m}' THEN {p[i]}" for m, p in usage.PRICES.items()) + \
    f" ELSE {usage.PRICES[usage.DEFAULT_PRICE_MODEL][i]} END"


@query("usage_rollup", sql=f"""
WITH {CALLS},
c AS (SELECT *, NOT is_cached AND total_tokens IS NOT NULL AS live FROM calls)
SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category,
  CAST(coalesce(sum(CASE WHEN live THEN prompt_tokens END), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(CASE WHEN live THEN completion_tokens END), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(CASE WHEN live THEN total_tokens END), 0) AS BIGINT) AS total_tokens,
  count_if(live) AS api_calls, count_if(is_cached) AS cached_calls,
  round(coalesce(sum(CASE WHEN live THEN prompt_tokens / 1000000 * ({_PRICE_CASE('model', 0)})
                     + completion_tokens / 1000000 * ({_PRICE_CASE('model', 1)}) END), 0.0), 4) AS cost_usd,
  round(CASE WHEN count_if(live) + count_if(is_cached) > 0
        THEN count_if(is_cached) * 100.0 / (count_if(live) + count_if(is_cached)) ELSE 0.0 END, 6) AS cached_pct
FROM c GROUP BY GROUPING SETS ((category), ())
""")
def usage_rollup(spark, sf):
    """A3 + J8: tokens, calls, cached share and cost per category and in total."""
    return usage.usage_rollup(bindings.calls(spark, sf))


@query("progress", sql=f"""
WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS rn FROM events),
b AS (SELECT (rn - 1) // {PROGRESS_BATCH} AS batch_id, count(*) AS n,
             count_if(event_type <> 'error') AS n_ok FROM r GROUP BY 1),
t AS (SELECT count(*) AS total FROM events)
SELECT CAST(batch_id AS BIGINT) AS batch_id, n, n_ok,
       CAST(sum(n_ok) OVER (ORDER BY batch_id) AS BIGINT) AS cum_ok,
       round(sum(n_ok) OVER (ORDER BY batch_id) * 100.0 / total, 6) AS pct_done
FROM b, t
""")
def progress(spark, sf):
    """Cumulative share of requested rows completed after each batch.

    Row numbers and the running sum both come from range-partitioned helpers
    (no single-partition window, even over the per-batch aggregate)."""
    ev = read_table(spark, sf, "events", ["event_id", "event_type"])
    numbered = row_number_within(ev, [], ["event_id"], out="rn")
    b = (numbered.groupBy(F.floor((F.col("rn") - 1) / PROGRESS_BATCH).cast("bigint")
                          .alias("batch_id"))
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.count_if(F.col("event_type") != "error").alias("n_ok")))
    total = ev.count()   # one scalar: rows requested
    c = cumulative_sum(b, ["batch_id"], "n_ok", out="cum_ok")
    return c.select("batch_id", "n", "n_ok", F.col("cum_ok").cast("bigint").alias("cum_ok"),
                    F.round(F.col("cum_ok") * 100.0 / F.lit(total), 6).alias("pct_done"))


def _requests(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    models = F.array(*[F.lit(m) for m in bindings.CALL_MODELS])
    r = ev.select(
        F.col("event_id").alias("call_id"), "event_type", "ts", "value",
        F.element_at(models, (F.pmod("user_id", F.lit(5)) + 1).cast("int")).alias("model"),
        F.concat(F.col("event_type"), F.lit(": "), F.col("props")).alias("prompt"))
    return r.withColumn("key", usage.request_key(F.col("model"), F.col("prompt"),
                                                 TEMPERATURE, MAX_TOKENS))


def _cache(req):
    """Earlier answers: every non-error request; one entry per key (last write wins)."""
    ts = F.when(F.col("value") < 1, F.lit("n/a")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return (req.where(F.col("event_type") != "error")
               .groupBy("key").agg(F.max_by(ts, F.col("call_id")).alias("timestamp")))


_KEY_SQL = ("md5('{\"max_tokens\": " + str(MAX_TOKENS) + ", \"model\": \"' || model || "
            "'\", \"prompt\": \"' || replace(replace(prompt, '\\', '\\\\'), '\"', '\\\"') || "
            "'\", \"temperature\": " + repr(TEMPERATURE) + "}')")
_REQ_SQL = f"""
req AS (SELECT call_id, event_type, ts, value, model, prompt, {_KEY_SQL} AS key FROM (
  SELECT event_id AS call_id, event_type, ts, value, {MODELS_ARR}[user_id % 5 + 1] AS model,
         event_type || ': ' || props AS prompt FROM events)),
cache AS (SELECT key, arg_max(CASE WHEN value < 1 THEN 'n/a'
                 ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END, call_id) AS timestamp
          FROM req WHERE event_type <> 'error' GROUP BY key)"""


@query("cache_lookup", sql=f"""
WITH {_REQ_SQL}
SELECT call_id, req.key, cache.key IS NOT NULL AS hit FROM req LEFT JOIN cache USING (key)
""")
def cache_lookup(spark, sf):
    """P27 + J5: request key (md5 of sorted-key JSON) looked up in the cache."""
    req = _requests(spark, sf)
    return usage.cache_lookup(req, _cache(req)).select("call_id", "key", "hit")


@query("cache_stats", sql=f"""
WITH {_REQ_SQL},
l AS (SELECT cache.key IS NOT NULL AS hit FROM req LEFT JOIN cache USING (key))
SELECT count_if(hit) AS hits, count_if(NOT hit) AS misses, count(*) AS total_calls,
       (SELECT count(*) FROM cache) AS cache_size,
       round(CASE WHEN count(*) > 0 THEN count_if(hit) * 100.0 / count(*) ELSE 0.0 END, 6) AS hit_rate
FROM l
""")
def cache_stats(spark, sf):
    """A4: hits, misses, total, hit rate, size."""
    req = _requests(spark, sf)
    cache = _cache(req)
    return usage.cache_stats(usage.cache_lookup(req, cache), cache)


@query("cache_ttl", sql=f"""
WITH {_REQ_SQL}
SELECT key, timestamp FROM cache
WHERE try_cast(timestamp AS TIMESTAMP) IS NOT NULL
  AND try_cast(timestamp AS TIMESTAMP) >= TIMESTAMP '{CACHE_NOW}' - INTERVAL {CACHE_DAYS} DAY
""")
def cache_ttl(spark, sf):
    """F8: entries older than the TTL or with unparsable timestamps are evicted."""
    return usage.cache_ttl(_cache(_requests(spark, sf)), CACHE_NOW, CACHE_DAYS)
