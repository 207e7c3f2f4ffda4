"""Dataset translation as joins (K5: P30, J1, J5, F7, U4, U5, A16, A17).

Every translatable field of an entry (a string, an array of strings, a map to
strings, or one of these inside a struct, named with a dot) becomes unit rows
``(id, field, pos, text)``; the model call is a left join with a response table
keyed by the unit.  A unit without a response row is *pending*: it is not taken
for translated.  Outcomes are reduced per entry (skipped if any unit hit the
content filter, failed if any other error, pending if any answer is missing,
else ok) and the entry is rebuilt with all its other columns.  Resume is an
anti-join with what is already done, so no whole-file rewrite per batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import error_class, is_content_filtered, py_strip, suggested_wait
from weft.operators.responses import last_response

MAX_RETRIES = 3


def _kind(df: DataFrame, field: str) -> str:
    t = df.select(F.col(field)).schema[0].dataType.typeName()
    return t if t in ("array", "map") else "string"


def _in_order(field: str) -> Column:
    """A map's entries in the order of their keys."""
    return F.array_sort(F.map_entries(F.col(field)))


def explode_units(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row per (id, field, pos, text) of the fields given.  A string has
    position 0; a map's positions follow its sorted keys."""
    out = None
    for f in fields:
        kind = _kind(df, f)
        name = F.lit(f).alias("field")
        if kind == "array":
            part = df.select(id_col, name, F.posexplode(F.col(f)).alias("pos", "text"))
        elif kind == "map":
            part = df.select(id_col, name, F.posexplode(F.transform(_in_order(f), lambda e: e["value"])).alias("pos", "text"))
        else:
            part = df.filter(F.col(f).isNotNull()).select(id_col, name, F.lit(0).alias("pos"), F.col(f).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def apply_responses(units: DataFrame, responses: DataFrame, keys: list[str],
                    order_col: str | None = None) -> DataFrame:
    """J5 + P30: left join with the response table (``content``, ``error``; the
    last row of a key counts); result stripped, ``None`` content keeps the
    original; outcome per unit, ``pending`` where no response is stored."""
    stored = last_response(responses, keys, order_col).withColumn("_answered", F.lit(True))
    j = units.join(stored, keys, "left")
    status = (F.when(is_content_filtered(F.col("error")), F.lit("skipped"))
               .when(F.col("error").isNotNull(), F.lit("failed"))
               .when(F.col("_answered").isNull() & F.col("text").isNotNull(), F.lit("pending"))
               .otherwise(F.lit("ok")))
    out_text = F.when((status == "ok") & F.col("content").isNotNull(), py_strip(F.col("content"))) \
                .otherwise(F.col("text"))
    return j.withColumn("unit_status", status).withColumn("out_text", out_text).drop("_answered")


def entry_status(unit_status: Column) -> Column:
    """U4 reduction: skipped > failed > pending > ok (as an aggregate expression)."""
    any_ = lambda k: F.max(F.when(unit_status == k, 1).otherwise(0)) == 1
    return (F.when(any_("skipped"), F.lit("skipped")).when(any_("failed"), F.lit("failed"))
             .when(any_("pending"), F.lit("pending")).otherwise(F.lit("ok")))


def _put(df: DataFrame, field: str, value: Column) -> DataFrame:
    """``field`` (or a field of a struct column) replaced."""
    top, _, inner = field.partition(".")
    return df.withColumn(top, F.when(F.col(top).isNotNull(), F.col(top).withField(inner, value)) if inner else value)


def assemble(entries: DataFrame, units: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """The entries with their translated fields, all other columns, and
    ``status``, ``n_units``, ``n_translated``.  An entry without units is kept."""
    texts = [F.transform(F.array_sort(F.collect_list(
        F.when(F.col("field") == f, F.struct("pos", "out_text")))), lambda x: x["out_text"]).alias(f"_f{i}")
        for i, f in enumerate(fields)]
    done = units.groupBy(F.col(id_col).alias("_id")).agg(
        entry_status(F.col("unit_status")).alias("status"),
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col("unit_status") == "ok").alias("n_translated"), *texts)
    out = entries.join(done, F.col(id_col) == F.col("_id"), "left")
    for i, f in enumerate(fields):
        kind, new = _kind(entries, f), F.col(f"_f{i}")
        if kind == "map":
            keys = F.transform(_in_order(f), lambda e: e["key"])
            new = F.map_from_arrays(keys, new)
        elif kind == "string":
            new = F.get(new, F.lit(0))
        out = _put(out, f, F.when(F.col(f).isNotNull() & F.col("n_units").isNotNull(), new).otherwise(F.col(f)))
    return (out.withColumn("status", F.coalesce("status", F.lit("ok")))
               .withColumn("n_units", F.coalesce("n_units", F.lit(0).cast("long")))
               .withColumn("n_translated", F.coalesce("n_translated", F.lit(0).cast("long")))
               .drop("_id", *[f"_f{i}" for i in range(len(fields))]))


def error_report(units: DataFrame, attempt: int = MAX_RETRIES - 1) -> DataFrame:
    """A16 + P28 + P29: error-type histogram with the suggested waits."""
    errs = units.where(F.col("error").isNotNull() & ~is_content_filtered(F.col("error")))
    return errs.groupBy(error_class(F.col("error")).alias("key")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(suggested_wait(F.col("error"), F.lit(attempt))).cast("bigint").alias("wait_s"))
