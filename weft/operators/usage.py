"""Call log, price lookup, usage roll-up and the response cache as tables
(A3, A4, J5, J8, P27, F8, W6).

The response cache is a table keyed by request hash; a lookup is a left join
(the source's in-memory dict), so cached responses are reused at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.jsonx import json_str

# Price per 1M tokens (prompt, completion); unknown models are
# priced as the default model.
PRICES = {
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (5.00, 15.00),
    "gpt-4": (30.00, 60.00),
    "gpt-3.5-turbo": (0.50, 1.50),
}
DEFAULT_PRICE_MODEL = "gpt-4o-mini"


def _price(model: Column, which: int) -> Column:
    """J8 as an expression: a literal map lookup (no join, stays in codegen)."""
    m = F.create_map(*[x for k, v in PRICES.items() for x in (F.lit(k), F.lit(v[which]))])
    return F.coalesce(F.element_at(m, model), F.lit(PRICES[DEFAULT_PRICE_MODEL][which]))


def call_cost(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    return (prompt_tokens / 1_000_000 * _price(model, 0)
            + completion_tokens / 1_000_000 * _price(model, 1))


def usage_rollup(calls: DataFrame, category: str = "category") -> DataFrame:
    """A3: per category and grand total (GROUPING SETS ((category), ())).

    Cached calls count as calls but add no tokens; cost uses each call's model.
    """
    live = ~F.col("is_cached") & F.col("total_tokens").isNotNull()

    def tok(c: str) -> Column:
        return F.coalesce(F.sum(F.when(live, F.col(c))), F.lit(0)).cast("bigint")
    cost = F.when(live, call_cost(F.col("model"), F.col("prompt_tokens"),
                                  F.col("completion_tokens")))
    agg = (calls.groupingSets([[category], []], category)
                .agg(tok("prompt_tokens").alias("prompt_tokens"),
                     tok("completion_tokens").alias("completion_tokens"),
                     tok("total_tokens").alias("total_tokens"),
                     F.count_if(live).alias("api_calls"),
                     F.count_if(F.col("is_cached")).alias("cached_calls"),
                     F.coalesce(F.sum(cost), F.lit(0.0)).alias("_cost"),
                     F.grouping(category).alias("_g")))
    calls_all = F.col("api_calls") + F.col("cached_calls")
    return agg.select(
        F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(category)).alias("category"),
        "prompt_tokens", "completion_tokens", "total_tokens", "api_calls", "cached_calls",
        F.round("_cost", 4).alias("cost_usd"),
        F.round(F.when(calls_all > 0, F.col("cached_calls") * 100.0 / calls_all)
                .otherwise(0.0), 6).alias("cached_pct"))


def request_key(model: Column, prompt: Column, temperature: float, max_tokens: int) -> Column:
    """md5 of the sorted-key JSON of {max_tokens, model, prompt, temperature},
    spelled exactly as ``json.dumps(sort_keys=True, ensure_ascii=False)``."""
    doc = F.concat(F.lit(f'{{"max_tokens": {int(max_tokens)}, "model": '), json_str(model),
                   F.lit(', "prompt": '), json_str(prompt),
                   F.lit(f', "temperature": {float(temperature)!r}}}'))
    return F.md5(doc)


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Left join on the request key; ``hit`` flag.  The cache side is
    reduced to distinct keys first (a dict holds each key once)."""
    keys = cache.groupBy(key).agg(F.lit(True).alias("hit"))
    return (requests.join(keys, key, "left")
                    .withColumn("hit", F.coalesce(F.col("hit"), F.lit(False))))


def cache_stats(looked_up: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """A4: hits, misses, total calls, hit rate (%), cache size."""
    size = cache.agg(F.count_distinct(key).alias("cache_size"))
    stats = looked_up.agg(F.count_if("hit").alias("hits"),
                          F.count_if(~F.col("hit")).alias("misses"),
                          F.count(F.lit(1)).alias("total_calls"))
    # two single-row aggregates merged by union + max (no join needed)
    both = stats.unionByName(size, allowMissingColumns=True)
    cols = ["hits", "misses", "total_calls", "cache_size"]
    return (both.agg(*[F.max(c).alias(c) for c in cols])
                .withColumn("hit_rate", F.round(F.when(F.col("total_calls") > 0,
                            F.col("hits") * 100.0 / F.col("total_calls")).otherwise(0.0), 6)))


def cache_ttl(cache: DataFrame, now_ts: str, days: int, ts_col: str = "timestamp") -> DataFrame:
    """F8: keep entries no older than ``days`` before ``now``; unparsable
    timestamps are evicted."""
    t = F.try_to_timestamp(F.col(ts_col))
    cutoff = F.to_timestamp(F.lit(now_ts)) - F.expr(f"INTERVAL {int(days)} DAYS")
    return cache.where(t.isNotNull() & (t >= cutoff))
