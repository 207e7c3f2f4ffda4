"""Registry of driver queries: Spark callable + matching DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` returns HUGEINT where Spark's returns bigint:
    wrap every call in ``CAST(... AS BIGINT)`` (values are unchanged)."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append("CAST(" + bigint_counts(sql[j:k + 1].replace(key, "\0", 1)).replace("\0", key, 1)
                   + " AS BIGINT)")
        i = k + 1


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the oracle (DuckDB, over the driver views).  ``None`` means the
    operator is not SQL-expressible at whole-table size; it is then tested
    against a brute-force fixture in pytest instead.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = bigint_counts(sql.strip())
        return fn
    return deco
