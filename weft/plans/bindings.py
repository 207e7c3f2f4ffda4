"""Driver-table bindings: the reference's record types derived from the given
tables by Spark (so every query's work grows with the tables).

* ``drills``  – MT-Bench-style drills from ``conversations``.
* ``exam``    – multiple-choice items from ``part``.
* ``calls``   – model call log from ``events``.
* ``preds``   – classification predictions from ``lineitem``.
* ``gen_pairs`` – hypothesis/reference pairs from ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.tables import read_table

# The nine drill categories (title case, as the generator's
# configuration spells them); category = CATEGORIES[conv_id mod 9].
CATEGORIES = ("Coding", "Extraction", "Knowledge III", "Math", "Reasoning",
              "Roleplay", "Social Science", "STEM", "Writing")
# Model names on the call log; the last is not in the price table.
CALL_MODELS = ("gpt-4o-mini", "gpt-4o", "gpt-4", "gpt-3.5-turbo", "other-model")


def category_of(idx_col) -> F.Column:
    arr = F.array(*[F.lit(c) for c in CATEGORIES])
    return F.element_at(arr, (F.pmod(idx_col, F.lit(len(CATEGORIES))) + 1).cast("int"))


def _texts_in_order(role: str) -> F.Column:
    """Texts of one role, ordered by turn (collect_list itself is unordered)."""
    items = F.array_sort(F.collect_list(
        F.when(F.col("role") == role, F.struct("turn", "text"))))
    return F.transform(items, lambda x: x["text"])


def drills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drill per conversation: ``turns`` = user texts, ``reference`` =
    assistant texts, both in turn order; ``category`` from ``conv_id``."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return (conv.groupBy("conv_id")
                .agg(_texts_in_order("user").alias("turns"),
                     _texts_in_order("assistant").alias("reference"),
                     F.try_element_at(_texts_in_order("system"), F.lit(1)).alias("system"))
                .withColumn("category", category_of(F.col("conv_id"))))


def exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice items (wide form, like the hub rows): question, a..e,
    answer letter.  ``e`` is missing for every tenth size, giving 4-choice rows."""
    p = read_table(spark, sf_dir, "part",
                   ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.split(F.col("p_type"), " ").getItem(0).alias("subset"),
        F.col("p_name").alias("question"),
        F.col("p_brand").alias("a"),
        F.col("p_type").alias("b"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("c"),
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("d"),
        F.when(F.pmod(F.col("p_size"), F.lit(10)) != 0,
               F.concat(F.lit("brand "), F.upper(F.col("p_brand")))).alias("e"),
        F.char(F.pmod(F.col("p_partkey"), F.lit(5)) + 97).alias("answer"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model call log: one call per event."""
    ev = read_table(spark, sf_dir, "events",
                    ["event_id", "ts", "user_id", "event_type", "value"])
    models = F.array(*[F.lit(m) for m in CALL_MODELS])
    return ev.select(
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("category"),
        F.element_at(models, (F.pmod(F.col("user_id"), F.lit(len(CALL_MODELS))) + 1)
                     .cast("int")).alias("model"),
        F.floor(F.col("value") * 10).cast("bigint").alias("prompt_tokens"),
        F.floor(F.col("value") * 3).cast("bigint").alias("completion_tokens"),
        (F.pmod(F.col("event_id"), F.lit(4)) == 0).alias("is_cached"),
        F.col("ts"),
    ).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions at scale: subset = return flag, gold = (line - 1) mod 5,
    pred = quantity mod 6 (5 = could not answer)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"])
    return li.select(
        F.col("l_returnflag").alias("subset"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        F.pmod(F.col("l_linenumber") - 1, F.lit(5)).cast("bigint").alias("gold"),
        F.pmod(F.floor(F.col("l_quantity")), F.lit(6)).cast("bigint").alias("pred"),
    )


def gen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypothesis/reference pairs: document 2k is scored against 2k+1.

    An equi-join on ``floor(doc_id / 2)``: evenly spread, no language window.
    """
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    k = F.floor(F.col("doc_id") / 2)
    hyp = d.where(F.pmod("doc_id", F.lit(2)) == 0).select(
        k.alias("pair_id"), F.col("text").alias("hyp"), F.col("lang"))
    ref = d.where(F.pmod("doc_id", F.lit(2)) == 1).select(
        k.alias("pair_id"), F.col("text").alias("ref"))
    return hyp.join(ref, "pair_id")
