"""Explicit-order helpers: exact row numbers without single-task windows.

``Window.partitionBy(category).orderBy(...)`` runs each category in one task,
so parallelism is capped by the number of categories and a category holding a
third of all rows becomes one third of the job in one task.  Instead:

1. ``repartitionByRange`` on (group, order) – balanced, contiguous ranges;
2. reliable ``checkpoint()`` – pins the sampled range bounds (they are
   re-sampled on every execution otherwise) and cuts lineage, so a lost
   executor recomputes from the shared checkpoint directory;
3. sort within partitions and take each row's index inside its partition;
4. a tiny table of per-(partition, group) counts gives each range's offset
   (window over pre-aggregated data: at most partitions + groups rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import ensure_checkpoint_dir


def row_number_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                      out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number()`` per group ordered by ``order_cols``.

    ``order_cols`` must make the order total (ties would be broken arbitrarily,
    exactly like ``row_number``).  Works for zero groups (global numbering).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    ranged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    g = [*group_cols]
    per_part = ranged.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_cnt"),
                                              F.min("_mid").alias("_base"))
    w = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy("_pid")
    offsets = per_part.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    small = offsets.select(F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_o_{i}") for i, c in enumerate(g)], "_off", "_base")
    on = F.col("_pid") == F.col("_opid")
    for i, c in enumerate(g):                   # a null group is a group
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{i}"))
    return (ranged.join(small, on)
                  .withColumn(out, F.col("_off") + F.col("_mid") - F.col("_base") + 1)
                  .select(*df.columns, out))


def cumulative_sum(df: DataFrame, order_cols: list[str], value_col: str, out: str = "cum",
                   num_partitions: int | None = None) -> DataFrame:
    """Running total of ``value_col`` in ``order_cols`` order, without a
    single-partition window: range partitions (checkpointed so the bounds are
    fixed), a local running sum inside each partition, plus the partition's
    offset from a table with one row per partition."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .checkpoint(eager=True))
    local = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_pid").agg(F.sum(value_col).alias("_t"))
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (ranged.withColumn("_local", F.sum(value_col).over(local))
                  .join(offsets.select("_pid", "_off"), "_pid")
                  .withColumn(out, F.col("_off") + F.col("_local"))
                  .drop("_pid", "_local", "_off"))
