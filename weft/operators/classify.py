"""Classification metrics as aggregations (A5 report, A6 confusion, A7 subset
mean, A19 sequence-score argmax).

The only pass over the prediction rows is one partial aggregate to the
confusion table (subset x gold x pred); everything after that is bounded by
the number of classes, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class names by id (a..e, then "Could not answer").
CLASS_NAMES = ("a", "b", "c", "d", "e", "Could not answer")


def confusion(preds: DataFrame, gold: str = "gold", pred: str = "pred",
              by: list[str] | None = None) -> DataFrame:
    """``groupBy(by, gold, pred).count()`` with class names."""
    by = by or []
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])

    def name(c: str) -> Column:
        return F.coalesce(F.try_element_at(names, (F.col(c) + 1).cast("int")),
                          F.col(c).cast("string"))
    return (preds.groupBy(*by, gold, pred).agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("gold_name", name(gold)).withColumn("pred_name", name(pred)))


def _safe_div(a: Column, b: Column) -> Column:
    """Zero division -> 0 (the report's zero_division default)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class(conf: DataFrame, gold: str = "gold", pred: str = "pred",
              by: list[str] | None = None) -> DataFrame:
    """Per-class tp / support / predicted and P/R/F1; classes = golds U preds."""
    by = by or []
    stacked = conf.select(*by, F.explode(F.array(
        F.struct(F.col(gold).alias("cls"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )).alias("s")).select(*by, "s.*")
    pc = stacked.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"),
                                        F.sum("support").alias("support"),
                                        F.sum("predicted").alias("predicted"))
    p = _safe_div(F.col("tp"), F.col("predicted"))
    r = _safe_div(F.col("tp"), F.col("support"))
    return (pc.withColumn("precision", p).withColumn("recall", r)
              .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                          F.col("precision") + F.col("recall"))))


def report(preds: DataFrame, gold: str = "gold", pred: str = "pred",
           by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """A5: accuracy; micro, macro, weighted precision/recall/F1 per ``by`` group.

    Macro averages run over golds U preds (a class only predicted counts with
    recall 0); weighted averages use gold support; micro P = R = F1 = accuracy
    for single-label data.
    """
    by = by or []
    pc = per_class(confusion(preds, gold, pred, by), gold, pred, by)
    tot = F.sum("support")
    acc = F.sum("tp") / tot

    def wavg(c: str) -> Column:
        return _safe_div(F.sum(F.col(c) * F.col("support")), tot)
    agg = pc.groupBy(*by).agg(
        acc.alias("accuracy"),
        _safe_div(F.sum("tp"), F.sum("predicted")).alias("micro_prec"),
        _safe_div(F.sum("tp"), tot).alias("micro_rec"),
        F.avg("precision").alias("macro_prec"), F.avg("recall").alias("macro_rec"),
        F.avg("f1").alias("macro_f1"),
        wavg("precision").alias("weighted_prec"), wavg("recall").alias("weighted_rec"),
        wavg("f1").alias("weighted_f1"),
        tot.cast("bigint").alias("n"))
    agg = agg.withColumn("micro_f1", _safe_div(
        2 * F.col("micro_prec") * F.col("micro_rec"), F.col("micro_prec") + F.col("micro_rec")))
    metric_cols = ["accuracy", "micro_prec", "micro_rec", "micro_f1", "macro_prec",
                   "macro_rec", "macro_f1", "weighted_prec", "weighted_rec", "weighted_f1"]
    return agg.select(*by, *[F.round(c, digits).alias(c) for c in metric_cols], "n")


def subset_mean(rep: DataFrame, metric: str = "accuracy", digits: int = 6) -> DataFrame:
    """Unweighted mean of a per-subset metric."""
    return rep.agg(F.round(F.avg(metric), digits).alias(f"mean_{metric}"),
                   F.count(F.lit(1)).alias("n_subsets"))


def sequence_argmax(tok: DataFrame, item: str = "item_id", label: str = "label",
                    logprob: str = "logprob", mask: str = "mask") -> DataFrame:
    """score = sum of masked token log-probs per (item, label); the best
    label per item, ties to the lowest label (like ``argmax``).

    Two partial aggregates; ``max_by`` with a (score, -label) key needs no
    window or sort.
    """
    scores = tok.groupBy(item, label).agg(
        F.coalesce(F.sum(F.when(F.col(mask) == 1, F.col(logprob))), F.lit(0.0)).alias("score"))
    key = F.struct(F.col("score"), (-F.col(label)).alias("neg"))
    return scores.groupBy(item).agg(
        F.max_by(F.col(label), key).alias("best_label"),
        F.max("score").alias("best_score"),
        F.count(F.lit(1)).alias("n_labels"))
