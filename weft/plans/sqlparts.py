"""SQL fragments shared by the DuckDB oracles (the same derivations as
``weft.plans.bindings``)."""

from __future__ import annotations

from weft.plans.bindings import CALL_MODELS, CATEGORIES


def _arr(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


CATS_ARR = _arr(CATEGORIES)
MODELS_ARR = _arr(CALL_MODELS)


def norm_cat(expr: str) -> str:
    return f"replace(replace({expr}, ' III', '_III'), ' ', '_')"


# drills: one row per conversation (turns / reference in turn order)
DRILLS = f"""
drills AS (
  SELECT conv_id,
         coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'user'), []) AS turns,
         coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'assistant'), []) AS reference,
         (list(text ORDER BY turn) FILTER (WHERE role = 'system'))[1] AS system,
         {CATS_ARR}[conv_id % 9 + 1] AS category
  FROM conversations GROUP BY conv_id)"""

CALLS = f"""
calls AS (
  SELECT event_id AS call_id, event_type AS category,
         {MODELS_ARR}[user_id % 5 + 1] AS model,
         CAST(floor(value * 10) AS BIGINT) AS prompt_tokens,
         CAST(floor(value * 3) AS BIGINT) AS completion_tokens,
         CAST(floor(value * 10) AS BIGINT) + CAST(floor(value * 3) AS BIGINT) AS total_tokens,
         event_id % 4 = 0 AS is_cached, ts
  FROM events)"""


def strip_sql(expr: str) -> str:
    """Python ``str.strip()`` in DuckDB (same whitespace class as Spark)."""
    from weft.functions.text import WS_CLASS
    return f"regexp_replace({expr}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


EXAM = """
exam AS (
  SELECT p_partkey AS item_id, split_part(p_type, ' ', 1) AS subset, p_name AS question,
         p_brand AS a, p_type AS b, 'size ' || CAST(p_size AS VARCHAR) AS c,
         'part ' || CAST(p_partkey AS VARCHAR) AS d,
         CASE WHEN p_size % 10 <> 0 THEN 'brand ' || upper(p_brand) END AS e,
         chr(CAST(97 + p_partkey % 5 AS INTEGER)) AS answer
  FROM part)"""
