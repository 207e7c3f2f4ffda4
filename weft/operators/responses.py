"""The model-call boundary (V1, J5): responses come from a table joined on
the request key (default, deterministic) or from a user batch function run
with ``mapInPandas`` (bounded concurrency = number of partitions)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def last_response(responses: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """One response per key: the last written by ``order_col`` (ties, and tables
    without it: the greatest row, so that a rerun picks the same one)."""
    rest = [c for c in responses.columns if c not in keys]
    order = [order_col] if order_col else []
    whole = F.struct(*order, *[c for c in rest if c not in order])
    return responses.groupBy(*keys).agg(F.max(whole).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def respond_from_table(requests: DataFrame, responses: DataFrame, key: str = "key",
                       order_col: str | None = None) -> DataFrame:
    """Left join with the response table; ``hit``: the key is stored, even
    with a null response."""
    order_col = order_col or ("timestamp" if "timestamp" in responses.columns else None)
    stored = last_response(responses, [key], order_col).withColumn("hit", F.lit(True))
    return requests.join(stored, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def respond_with(requests: DataFrame, fn: Callable[[list[str]], list[str]],
                 prompt_col: str = "prompt", out_col: str = "response",
                 concurrency: int | None = None, batch_size: int = 25) -> DataFrame:
    """V1: ``fn(list of prompts) -> list of responses`` called per batch of
    ``batch_size`` rows inside ``mapInPandas``; ``concurrency`` partitions run
    at once (the source's semaphore)."""
    df = requests.repartition(concurrency) if concurrency else requests
    schema = StructType(df.schema.fields + [StructField(out_col, StringType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            outs: list[str] = []
            prompts = pdf[prompt_col].tolist()
            for i in range(0, len(prompts), batch_size):
                outs.extend(fn(prompts[i:i + batch_size]))
            yield pdf.assign(**{out_col: outs})
    return df.mapInPandas(run, schema)
