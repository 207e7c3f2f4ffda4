"""Driver queries: generation planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import normalize_category
from weft.operators import quota
from weft.plans import bindings
from weft.plans.registry import query
from weft.plans.sqlparts import DRILLS, norm_cat

# Configured categories (normalised names, in configuration order).
CONFIG_CATEGORIES = [c.replace(" III", "_III").replace(" ", "_") for c in bindings.CATEGORIES]
QUOTA_MULTIPLIER = 2      # total quota = 2 x drills present
CHUNK_SIZE = 10
MIN_BATCH, MAX_BATCH = 3, 5

_CFG_SQL = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CONFIG_CATEGORIES)) \
    + ") AS cfg(ordinal, category)"
_K = len(CONFIG_CATEGORIES)

_QUOTA_SQL = f"""
{DRILLS},
ex AS (SELECT {norm_cat('category')} AS category, count(*) AS n FROM drills GROUP BY 1),
tot AS (SELECT {QUOTA_MULTIPLIER} * count(*) AS total FROM drills),
q AS (SELECT ordinal, category, total // {_K} + CASE WHEN ordinal < total % {_K} THEN 1 ELSE 0 END AS target
      FROM {_CFG_SQL}, tot),
rem AS (SELECT ordinal, q.category, CAST(target AS BIGINT) AS target,
               CAST(coalesce(n, 0) AS BIGINT) AS n_existing,
               CAST(greatest(0, target - coalesce(n, 0)) AS BIGINT) AS remaining
        FROM q LEFT JOIN ex USING (category))"""


def _quota(spark, sf):
    d = bindings.drills(spark, sf)
    return d, quota.planned_quota(quota.category_counts(d), CONFIG_CATEGORIES, QUOTA_MULTIPLIER)


@query("quota_plan", sql=f"WITH {_QUOTA_SQL} SELECT * FROM rem")
def quota_plan(spark, sf):
    """A1 + A2: remaining items per configured category."""
    return _quota(spark, sf)[1]


@query("question_ids", sql=f"""
WITH {DRILLS},
c AS (SELECT conv_id, category, {norm_cat('category')} AS ncat,
             len(turns) = len(reference) AS complete FROM drills),
n AS (SELECT ncat, count(*) AS n_existing FROM c WHERE complete GROUP BY ncat),
x AS (SELECT conv_id, category, ncat,
             row_number() OVER (PARTITION BY ncat ORDER BY conv_id) AS rn FROM c WHERE NOT complete)
SELECT conv_id, category, CAST(coalesce(n_existing, 0) + rn - 1 AS BIGINT) AS idx,
       printf('drill_%s_%04d', ncat, coalesce(n_existing, 0) + rn - 1) AS question_id
FROM x LEFT JOIN n USING (ncat)
""")
def question_ids(spark, sf):
    """W1 + P2: complete drills exist already; the others get running ids
    after them within their category (unique across chunks)."""
    d = bindings.drills(spark, sf).withColumn(
        "complete", F.size("turns") == F.size("reference"))
    existing = (d.where("complete")
                 .groupBy(normalize_category(F.col("category")).alias("category"))
                 .agg(F.count(F.lit(1)).alias("n_existing")))
    new = d.where(~F.col("complete")).select("conv_id", "category")
    return quota.assign_question_ids(new, existing, ["conv_id"]).select(
        "conv_id", "category", F.col("idx").cast("bigint").alias("idx"), "question_id")


@query("chunk_plan", sql=f"""
WITH {_QUOTA_SQL},
src AS (SELECT conv_id, lower({norm_cat('category')}) AS k,
               row_number() OVER (PARTITION BY lower({norm_cat('category')}) ORDER BY conv_id) AS rn,
               count(*) OVER (PARTITION BY lower({norm_cat('category')})) AS L FROM drills),
items AS (SELECT category AS plan_category, lower(category) AS k, unnest(range(remaining)) AS item_pos
          FROM rem WHERE remaining > 0)
SELECT plan_category, item_pos, item_pos // {CHUNK_SIZE} AS chunk_id, conv_id AS source_id
FROM items JOIN src ON src.k = items.k AND src.rn = item_pos % src.L + 1
""")
def chunk_plan(spark, sf):
    """Quota x source -> W7 cycling -> W2 chunks of ten."""
    d, q = _quota(spark, sf)
    return quota.oversample_plan(d, q, "conv_id", CHUNK_SIZE, id_col="conv_id")


@query("batch_plan", sql=f"""
WITH {_QUOTA_SQL},
items AS (SELECT category, remaining AS total, unnest(range(remaining)) AS pos FROM rem WHERE remaining > 0),
b AS (SELECT category, CASE
        WHEN pos < (total // {MAX_BATCH}) * {MAX_BATCH} THEN pos // {MAX_BATCH}
        WHEN total % {MAX_BATCH} > 0 AND total % {MAX_BATCH} <= {MIN_BATCH}
          THEN total // {MAX_BATCH} + (pos - (total // {MAX_BATCH}) * {MAX_BATCH})
        ELSE total // {MAX_BATCH} END AS batch_id FROM items)
SELECT category, CAST(batch_id AS BIGINT) AS batch_id, count(*) AS n_items FROM b GROUP BY ALL
""")
def batch_plan(spark, sf):
    """Batch sizes from the rule (<= min -> single, else min(max, remaining))."""
    return quota.batch_plan(_quota(spark, sf)[1], MIN_BATCH, MAX_BATCH)
