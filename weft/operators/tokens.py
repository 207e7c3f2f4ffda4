"""Token length, truncation and padding (P31) and length statistics.

The tokenizer is pluggable: any expression returning ``array<string>``; the
default is the regex tokenizer of the metrics module.  Ids and percentiles are
in ``trainset``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.genmetrics import tokens as default_tokens

MAX_LEN = 512


def truncate_pad(df: DataFrame, text: str, max_len: int = MAX_LEN,
                 tokenizer=default_tokens) -> DataFrame:
    """Original and truncated token counts, padding, attention mask size."""
    toks = tokenizer(F.col(text))
    kept = F.slice(toks, 1, max_len)
    return (df.withColumn("_toks", toks)
              .withColumn("n_tokens", F.size("_toks").cast("bigint"))
              .withColumn("n_kept", F.least(F.col("n_tokens"), F.lit(max_len)).cast("bigint"))
              .withColumn("n_pad", (F.lit(max_len) - F.col("n_kept")).cast("bigint"))
              .withColumn("truncated", F.col("n_tokens") > max_len)
              .withColumn("last_kept", F.try_element_at(kept, F.lit(-1)))
              .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("n_kept").cast("int")),
                                                     F.array_repeat(F.lit(0), F.col("n_pad").cast("int"))))
              .drop("_toks"))


def length_stats(t: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Original vs truncated length distribution per group."""
    return t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.avg("n_tokens"), digits).alias("avg_tokens"),
        F.max("n_tokens").alias("max_tokens"),
        F.round(F.avg("n_kept"), digits).alias("avg_kept"),
        F.count_if("truncated").alias("n_truncated"),
        F.round(F.count_if("truncated") / F.count(F.lit(1)), digits).alias("truncated_share"))
