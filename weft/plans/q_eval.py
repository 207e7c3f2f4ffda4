"""Driver queries: classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import classify
from weft.plans import bindings
from weft.plans.registry import query
from weft.sources.tables import read_table

_PREDS_SQL = """
p AS (SELECT l_returnflag AS subset, l_orderkey * 10 + l_linenumber AS item_id,
             CAST((l_linenumber - 1) % 5 AS BIGINT) AS gold,
             CAST(floor(l_quantity) AS BIGINT) % 6 AS pred FROM lineitem)"""

_LABEL_PREDS_SQL = """
p AS (SELECT 'quality' AS subset, CAST(l.quality AS BIGINT) AS gold,
             CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS pred
      FROM labels l JOIN documents d USING (doc_id)
      UNION ALL
      SELECT 'toxic', CAST(l.toxic AS BIGINT), CASE WHEN d.lang = 'en' THEN 0 ELSE 1 END
      FROM labels l JOIN documents d USING (doc_id))"""


def _report_sql(preds_cte: str, metric_round: bool = True) -> str:
    r = (lambda e: f"round({e}, 6)") if metric_round else (lambda e: e)
    return f"""
WITH {preds_cte},
conf AS (SELECT subset, gold, pred, count(*) AS n FROM p GROUP BY ALL),
st AS (SELECT subset, gold AS cls, n AS support, 0 AS predicted,
              CASE WHEN gold = pred THEN n ELSE 0 END AS tp FROM conf
       UNION ALL SELECT subset, pred, 0, n, 0 FROM conf),
pc AS (SELECT subset, cls, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted
       FROM st GROUP BY ALL),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS prec,
                CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rec FROM pc),
m2 AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM m),
a AS (SELECT subset, sum(tp) / sum(support) AS accuracy,
        CASE WHEN sum(predicted) = 0 THEN 0.0 ELSE sum(tp) / sum(predicted) END AS micro_prec,
        CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(tp) / sum(support) END AS micro_rec,
        avg(prec) AS macro_prec, avg(rec) AS macro_rec, avg(f1) AS macro_f1,
        sum(prec * support) / sum(support) AS weighted_prec,
        sum(rec * support) / sum(support) AS weighted_rec,
        sum(f1 * support) / sum(support) AS weighted_f1,
        CAST(sum(support) AS BIGINT) AS n
      FROM m2 GROUP BY subset)
SELECT subset, {r("accuracy")} AS accuracy, {r("micro_prec")} AS micro_prec,
  {r("micro_rec")} AS micro_rec,
  {r("CASE WHEN micro_prec + micro_rec = 0 THEN 0.0 ELSE 2 * micro_prec * micro_rec / (micro_prec + micro_rec) END")} AS micro_f1,
  {r("macro_prec")} AS macro_prec, {r("macro_rec")} AS macro_rec, {r("macro_f1")} AS macro_f1,
  {r("weighted_prec")} AS weighted_prec, {r("weighted_rec")} AS weighted_rec,
  {r("weighted_f1")} AS weighted_f1, n
FROM a"""


@query("cls_report", sql=_report_sql(_PREDS_SQL))
def cls_report(spark, sf):
    """A5 per subset over lineitem-derived predictions (scale case)."""
    return classify.report(bindings.preds(spark, sf), by=["subset"])


def _label_preds(spark, sf):
    lab = read_table(spark, sf, "labels", ["doc_id", "quality", "toxic"])
    doc = read_table(spark, sf, "documents", ["doc_id", "n_chars", "lang"])
    j = lab.join(doc, "doc_id")
    q = j.select(F.lit("quality").alias("subset"), F.col("quality").cast("bigint").alias("gold"),
                 F.when(F.col("n_chars") >= 1000, 1).otherwise(0).cast("bigint").alias("pred"))
    t = j.select(F.lit("toxic").alias("subset"), F.col("toxic").cast("bigint").alias("gold"),
                 F.when(F.col("lang") == "en", 0).otherwise(1).cast("bigint").alias("pred"))
    return q.unionByName(t)


@query("cls_report_labels", sql=_report_sql(_LABEL_PREDS_SQL))
def cls_report_labels(spark, sf):
    """A5 with real gold labels (labels join documents)."""
    return classify.report(_label_preds(spark, sf), by=["subset"])


@query("confusion", sql=f"""
WITH {_PREDS_SQL}
SELECT subset, gold, pred, count(*) AS n,
  coalesce(['a','b','c','d','e','Could not answer'][gold + 1], CAST(gold AS VARCHAR)) AS gold_name,
  coalesce(['a','b','c','d','e','Could not answer'][pred + 1], CAST(pred AS VARCHAR)) AS pred_name
FROM p GROUP BY subset, gold, pred
""")
def confusion(spark, sf):
    """Confusion matrix with class names per subset."""
    return classify.confusion(bindings.preds(spark, sf), by=["subset"])


@query("subset_mean", sql=f"""
WITH r AS ({_report_sql(_PREDS_SQL)})
SELECT round(avg(accuracy), 6) AS mean_accuracy, count(*) AS n_subsets FROM r
""")
def subset_mean(spark, sf):
    """Unweighted mean of per-subset accuracy."""
    return classify.subset_mean(classify.report(bindings.preds(spark, sf), by=["subset"]))


@query("logprob_argmax", sql="""
WITH t AS (SELECT l_orderkey AS item_id, CAST((l_linenumber - 1) % 3 AS BIGINT) AS label,
                  -CAST(CAST(floor(l_extendedprice) AS BIGINT) % 97 AS DOUBLE) / 8 AS logprob,
                  CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END AS mask FROM lineitem),
s AS (SELECT item_id, label, coalesce(sum(CASE WHEN mask = 1 THEN logprob END), 0.0) AS score
      FROM t GROUP BY item_id, label),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, label) AS rn,
             count(*) OVER (PARTITION BY item_id) AS n_labels,
             max(score) OVER (PARTITION BY item_id) AS best_score FROM s)
SELECT item_id, label AS best_label, best_score, n_labels FROM r WHERE rn = 1
""")
def logprob_argmax(spark, sf):
    """Masked log-prob sum per (item, label), argmax with ties to the lowest label."""
    li = read_table(spark, sf, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"])
    tok = li.select(
        F.col("l_orderkey").alias("item_id"),
        F.pmod(F.col("l_linenumber") - 1, F.lit(3)).cast("bigint").alias("label"),
        (-(F.pmod(F.floor("l_extendedprice"), F.lit(97))).cast("double") / F.lit(8.0))
        .alias("logprob"),
        F.when(F.col("l_quantity") > 5, 1).otherwise(0).alias("mask"))
    return classify.sequence_argmax(tok)
