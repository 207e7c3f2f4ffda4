"""Generation planning: counts, quotas, running ids, oversampling, chunks and
batch sizes (A1, A2, W1, W2, W7, W8, W9) as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import category_match_key, normalize_category, question_id
from weft.operators.ordering import row_number_within


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    """A1: rows per normalised category (partial aggregate)."""
    return (df.groupBy(normalize_category(F.col(category)).alias("category"))
              .agg(F.count(F.lit(1)).alias("n_existing")))


def remaining_quota(spark: SparkSession, existing: DataFrame, categories: list[str],
                    total: int) -> DataFrame:
    """A2: ``total // k`` per category, the first ``total % k`` categories get one
    more; minus existing, floored at 0.  ``existing``: (category, n_existing)."""
    k = len(categories)
    per, rem = divmod(total, k)
    cfg = spark.createDataFrame([(i, c) for i, c in enumerate(categories)],
                                "ordinal int, category string")
    target = (F.lit(per) + F.when(F.col("ordinal") < rem, 1).otherwise(0)).cast("bigint")
    # the config side has k rows (bounded by configuration, not data)
    return (cfg.join(existing, "category", "left")
              .select("ordinal", "category", target.alias("target"),
                      F.coalesce("n_existing", F.lit(0)).cast("bigint").alias("n_existing"))
              .withColumn("remaining", F.greatest(F.lit(0).cast("bigint"),
                                                  F.col("target") - F.col("n_existing"))))


def assign_question_ids(new: DataFrame, existing: DataFrame, order_cols: list[str],
                        category: str = "category") -> DataFrame:
    """W1 + P2: ``drill_{cat}_{existing + row_number - 1 :04d}`` within category.

    Unique ids across chunks (the source gave every chunk the same start).
    """
    numbered = row_number_within(new.withColumn("_cat", normalize_category(F.col(category))),
                                 ["_cat"], order_cols, out="_rn")
    ex = existing.select(F.col("category").alias("_cat"), "n_existing")
    return (numbered.join(ex, "_cat", "left")
                    .withColumn("idx", F.coalesce("n_existing", F.lit(0)) + F.col("_rn") - 1)
                    .withColumn("question_id", question_id(F.col(category), F.col("idx")))
                    .drop("_cat", "_rn", "n_existing"))


def planned_quota(existing: DataFrame, categories: list[str], multiple: int) -> DataFrame:
    """A2 with a total of ``multiple`` times the existing rows, those of other
    categories included: the total stays in the plan, no job runs for it.

    One row holds the sum and the counts of the configured categories (as many
    entries as the configuration has) and is unfolded to a row per category."""
    k = len(categories)
    mine = F.when(F.col("category").isin(categories), F.struct("category", "n_existing"))
    facts = existing.agg((F.lit(multiple) * F.coalesce(F.sum("n_existing"), F.lit(0))).cast("bigint").alias("_total"),
                         F.map_from_entries(F.collect_list(mine)).alias("_have"))
    each = facts.select("_total", "_have", F.posexplode(F.array(*map(F.lit, categories))).alias("ordinal", "category"))
    target = F.floor(F.col("_total") / k) + F.when(F.col("ordinal") < F.col("_total") % k, 1).otherwise(0)
    have = F.coalesce(F.try_element_at("_have", F.col("category")), F.lit(0))
    return (each.select("ordinal", "category", target.cast("bigint").alias("target"), have.cast("bigint").alias("n_existing"))
                .withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), F.col("target") - F.col("n_existing"))))


#: Numbers in one block of ``numbered``: its square root is the longest array made of one row.
BLOCK = 1 << 20


def numbered(rows: DataFrame, count: Column, out: str, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Each row once for every ``out`` in 0 .. ``count`` - 1.

    The numbers of a row are cut into intervals of ``block``, which are dealt out
    by ``keys`` and their own number, so one row with most of the numbers spans
    many tasks; an interval is unfolded in two steps of the square root of its
    size.  A count that is null or below 1 gives no row."""
    step = max(1, int(block ** 0.5))
    span = step * step
    pieces = rows.withColumn("_count", count.cast("bigint")).filter("_count > 0")
    pieces = pieces.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_count") - 1) / span))))
    # With a number of partitions: adaptive execution would join these few bytes in one task.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(tasks, *keys, "_block").withColumn("_from", F.col("_block") * span)

    def unfold(df: DataFrame, width: int) -> DataFrame:
        left = F.least(F.lit(step - 1).cast("bigint"), F.floor((F.col("_count") - 1 - F.col("_from")) / width))
        return (df.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), left)))
                  .withColumn("_from", F.col("_from") + F.col("_k") * width))

    return unfold(unfold(pieces, step), 1).withColumn(out, F.col("_from")).drop("_count", "_block", "_from", "_k")


def oversample_plan(source: DataFrame, quota: DataFrame, order_col: str,
                    chunk_size: int, category: str = "category",
                    id_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """W9 = A2 quota x source -> W7 cycling -> W2 chunks.

    For ``needed`` items and ``L`` source rows of a category, item ``i`` uses
    source row ``i mod L`` (first ``needed`` rows when ``needed <= L``).  So the
    r-th source row makes the items r, r + L, r + 2L ... itself: items meet no
    join, and only the quota (a row per configured category) is broadcast.
    Returns one row per item: category, item_pos, chunk_id, source row columns.
    """
    id_col = id_col or order_col
    src = source.withColumn("_key", category_match_key(F.col(category)))
    src = row_number_within(src, ["_key"], [order_col], out="_src_rn")
    sizes = src.groupBy("_key").agg(F.count(F.lit(1)).alias("_L"))
    need = (quota.where(F.col("remaining") > 0)
                 .select(F.col("category").alias("plan_category"),
                         F.lower(F.col("category")).alias("_key"), "remaining")
                 .join(sizes, "_key"))
    used = (src.select("_key", (F.col("_src_rn") - 1).alias("_r"), F.col(id_col).alias("source_id"))
               .join(F.broadcast(need), "_key").where(F.col("_r") < F.col("remaining")))
    cycles = F.floor((F.col("remaining") - F.col("_r") - 1) / F.col("_L")) + 1
    items = numbered(used, cycles, "_cycle", ["plan_category", "_r"], block)
    pos = F.col("_r") + F.col("_cycle") * F.col("_L")
    return items.select("plan_category", pos.cast("bigint").alias("item_pos"),
                        F.floor(pos / chunk_size).cast("bigint").alias("chunk_id"), "source_id")


def batch_plan(quota: DataFrame, min_batch: int, max_batch: int, block: int = BLOCK) -> DataFrame:
    """(category, batch_id, n_items) of each category's ``remaining`` items.
    Batches are numbered by intervals and sized in closed form; no item is made."""
    q = full_batches(F.col("remaining"), min_batch, max_batch)
    rest = F.col("remaining") - q * max_batch
    small = rest <= min_batch
    batches = numbered(quota.select("category", "remaining"), q + F.when(small, rest).otherwise(1), "batch_id", ["category"], block)
    size = F.when(F.col("batch_id") < q, F.lit(max_batch)).when(small, F.lit(1)).otherwise(rest)
    return batches.select("category", "batch_id", size.cast("bigint").alias("n_items"))


def batch_size(remaining: Column, min_batch: int, max_batch: int) -> Column:
    """``remaining <= min -> 1`` else ``min(max, remaining)``."""
    return F.when(remaining <= min_batch, F.lit(1)).otherwise(F.least(F.lit(max_batch), remaining))


def full_batches(total: Column, min_batch: int, max_batch: int) -> Column:
    """How many batches of ``max_batch`` are taken before a smaller one."""
    least = max(min_batch + 1, max_batch)      # what must remain for a full batch
    return F.when(total >= least, F.floor((total - least) / max_batch) + 1).otherwise(0).cast("bigint")


def batch_of_position(pos: Column, total: Column, min_batch: int, max_batch: int) -> Column:
    """W8 closed form: the batch index of item ``pos`` when ``total`` items are
    consumed by repeatedly taking ``batch_size(remaining)``.

    Full batches of ``max`` while more than ``max`` remain; then one batch of the
    rest if it exceeds ``min``, else single-item batches.
    """
    q = full_batches(total, min_batch, max_batch)
    rem = total - q * max_batch
    small_tail = (rem > 0) & (rem <= min_batch)
    return (F.when(pos < q * max_batch, F.floor(pos / max_batch))
             .when(small_tail, q + (pos - q * max_batch))
             .otherwise(q)).cast("bigint")
