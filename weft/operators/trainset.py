"""Token ids of training examples, their monitoring columns, and
the distribution of their lengths.

``vocabulary`` ranks tokens by how often they occur (ties by token): counts are
partial aggregates and ranks come from the range-partitioned row numbers, so no
token is a hot key and no task sees the whole vocabulary.

``encode`` looks ids up in two steps.  Text follows Zipf's law, so the ``head``
most frequent tokens (a bounded table, broadcast) stand for nearly all places; a
narrow pass gives those their ids and leaves, for a row, a numbered list of its
distinct other tokens.  Only that list is exploded and joined with the vocabulary,
by tokens that are rare; what comes back to a row is an array of ids, which its
places point into.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.genmetrics import tokens as default_tokens
from weft.operators.ordering import row_number_within
from weft.session import scratch_path

#: Ids below FIRST_ID are special; padding is one of them.  Tokens of the head.
PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2
HEAD = 65_536


def vocabulary(texts: DataFrame, text: str, tokenizer=default_tokens) -> DataFrame:
    """(token, n, token_id) of every token of ``texts``: the most frequent one has
    FIRST_ID."""
    counts = texts.select(F.explode(tokenizer(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = row_number_within(counts.withColumn("_less", -F.col("n")), [], ["_less", "token"], out="_rank")
    return ranked.select("token", "n", (F.col("_rank") - 1 + FIRST_ID).alias("token_id"))


def encode(examples: DataFrame, id_col: str, text: str, vocab: DataFrame, max_len: int = 512,
           tokenizer=default_tokens, decoder=lambda toks: F.array_join(toks, " "), head: int = HEAD) -> DataFrame:
    """The columns of ``examples`` and, after them, input_ids (cut to ``max_len``
    and padded to it), attention_mask, labels (a copy of input_ids) and the four
    monitoring columns input_content_original, _original_length, _truncated and
    _truncated_length.  ``id_col`` is unique; a token that ``vocab`` lacks gets
    UNKNOWN_ID; a null text has no tokens."""
    spark = examples.sparkSession
    top = vocab.where(F.col("token_id") < FIRST_ID + head).orderBy("token_id").select("token", "token_id").toArrow()
    shared = spark.sparkContext.broadcast((top.column("token").combine_chunks(), np.asarray(top.column("token_id"), np.int64)))
    toks = examples.select(F.col(id_col).alias("id"), tokenizer(F.col(text)).alias("toks"))
    toks = toks.select("id", F.slice("toks", 1, max_len).alias("toks"), F.size("toks").cast("long").alias("n"), decoder(F.slice("toks", 1, max_len)).alias("kept"))
    kind = toks.schema["id"].dataType.simpleString()

    def look_up(batches):
        known, known_ids = shared.value
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets, np.int64)
            flat = lists.flatten()
            ends = ends - ends[0]
            place = pc.index_in(flat, value_set=known.cast(flat.type))
            ids = np.where(np.asarray(place.is_valid()), known_ids[np.asarray(place.fill_null(0))] if len(known_ids) else 0, -1)
            # The other tokens, numbered within their rows, all rows of the batch at once.
            lost = np.flatnonzero(ids < 0)
            coded = flat.take(pa.array(lost)).dictionary_encode()
            row = np.searchsorted(ends, lost, side="right") - 1
            each, at = np.unique(row * max(1, len(coded.dictionary)) + np.asarray(coded.indices), return_inverse=True)
            starts = np.searchsorted(each, np.arange(len(lists) + 1) * max(1, len(coded.dictionary)))
            ids[lost] = -1 - (at - starts[row])
            rest = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), coded.dictionary.take(pa.array(each % max(1, len(coded.dictionary)))).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64())), batch.column(2),
                 batch.column(3), rest], names=["id", "ids", "n", "kept", "rest"])

    path = scratch_path(spark, "encode")
    toks.mapInArrow(look_up, f"id {kind}, ids array<long>, n long, kept string, rest array<string>").write.parquet(path)
    looked = spark.read.parquet(path)
    tail = (looked.select("id", F.posexplode("rest").alias("k", "token")).join(vocab.select("token", "token_id"), "token", "left")
                  .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("v")))).alias("tail"))
                  .select("id", F.transform("tail", lambda x: x["v"]).alias("tail")))
    found = F.transform("ids", lambda x: F.when(x >= 0, x).otherwise(F.get("tail", (-x - 1).cast("int"))))
    coded = looked.join(tail, "id", "left").select(F.col("id").alias("_id"), found.alias("_ids"), "n", "kept")
    pads = F.lit(max_len) - F.size("_ids")
    out = examples.join(coded, F.col(id_col) == F.col("_id"))
    input_ids = F.concat("_ids", F.array_repeat(F.lit(PAD_ID).cast("long"), pads))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), pads))
    return out.select(*[examples[c] for c in examples.columns], input_ids.alias("input_ids"), mask.alias("attention_mask"),
                      input_ids.alias("labels"), *monitor_columns(F.col(text), F.col("n"), F.col("kept"), F.lit(max_len).cast("long")))


def monitor_columns(original: Column, n: Column, truncated: Column, n_truncated: Column) -> list[Column]:
    """The columns of the monitoring table (lengths with padding, as the ids have it)."""
    return [original.alias("input_content_original"), n.alias("input_content_original_length"),
            truncated.alias("input_content_truncated"), n_truncated.alias("input_content_truncated_length")]


def length_histogram(lengths: DataFrame, by: list[str], length: str) -> DataFrame:
    """(by..., length, n): mergeable, as histograms of several runs add up."""
    return lengths.groupBy(*by, F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(*histograms: DataFrame) -> DataFrame:
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def percentiles(histogram: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Per group n, mean, max and for each (name, share) the least length
    that at least that share of the rows doesn't exceed.  Exact; the windows run
    over distinct lengths, not rows."""
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("length").rowsBetween(Window.unboundedPreceding, 0))
    h = histogram.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(group))
    return h.groupBy(*by).agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("length")) / F.sum("n"), 6).alias("mean"), F.max("length").alias("longest"),
        *[F.min(F.when(F.col("_upto") >= F.col("_all") * share, F.col("length"))).alias(name) for name, share in shares.items()])
