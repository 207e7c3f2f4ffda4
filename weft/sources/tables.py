"""Parquet table access (the driver tables and any written result table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; ``columns`` prunes the scan.

    Parallelism is the scan's own (file splits, by configuration); nothing is
    redistributed and no job runs while a query is built."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out to the configured number of shuffle partitions (by
    ``keys``, or round robin), in front of stages whose work per row is large
    for its bytes: adaptive execution goes by bytes and would give them few
    tasks.  The count is configuration, so nothing is run or measured here."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
