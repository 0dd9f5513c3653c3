"""Evaluation queries on scored labels: p = least(n_chars / 10000, 1), label = toxic."""

from __future__ import annotations

from riskloom.operators import metrics as MT
from riskloom.plans import fixtures as X
from riskloom.plans.catalog import register, table


def _scored(spark, sf):
    return X.scored_labels(table(spark, sf, "documents"), table(spark, sf, "labels"))


CUM = f"""
WITH s AS ({X.SCORED_LABELS_SQL}),
c AS (SELECT score, COUNT(CASE WHEN label = 1 THEN 1 END) AS pos, COUNT(CASE WHEN label <> 1 THEN 1 END) AS neg
      FROM s GROUP BY score),
t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM c),
cum AS (SELECT score, pos, neg, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp FROM c
        WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / (tp + fp) AS precision,
                 tp / (SELECT P FROM t) AS recall, pos FROM cum)"""

CELLS = f"""
WITH s AS ({X.SCORED_LABELS_SQL}),
k AS (SELECT COUNT(CASE WHEN label = 1 AND score > 0.5 THEN 1 END) AS tp,
             COUNT(CASE WHEN label = 0 AND score > 0.5 THEN 1 END) AS fp,
             COUNT(CASE WHEN label = 1 AND score <= 0.5 THEN 1 END) AS fn,
             COUNT(CASE WHEN label = 0 AND score <= 0.5 THEN 1 END) AS tn FROM s)"""

AUC_EXPR = """(SELECT SUM(pos * ((SELECT N FROM t) - fp) + 0.5 * pos * neg) / ((SELECT P FROM t) * (SELECT N FROM t)) FROM cum)"""


def d0(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


@register("pr_curve", CUM + """
SELECT ROUND(threshold, 6) AS threshold, tp, fp, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall FROM curve""")
def q_pr_curve(spark, sf):
    return MT.pr_curve(_scored(spark, sf))


@register("average_precision", CUM + """
SELECT ROUND(SUM(pos * precision) / (SELECT P FROM t), 6) AS average_precision FROM curve""")
def q_average_precision(spark, sf):
    return MT.average_precision(_scored(spark, sf))


@register("threshold_at_precision", CUM + """
SELECT ROUND(MIN(threshold), 6) AS threshold, ROUND(COALESCE(arg_min(recall, threshold), 0.0), 6) AS recall
FROM curve WHERE precision >= 0.8""")
def q_threshold_at_precision(spark, sf):
    return MT.threshold_at_precision(_scored(spark, sf), 0.8)


@register("auc", CUM + f"\nSELECT ROUND({AUC_EXPR}, 6) AS auc")
def q_auc(spark, sf):
    return MT.auc(_scored(spark, sf))


@register("classification_metrics", CUM.replace("WITH s AS", "WITH s AS", 1) + ",\n" + CELLS.split("WITH s AS (" + X.SCORED_LABELS_SQL + "),\n", 1)[1].strip() + f"""
SELECT tp + fp + fn + tn AS n, tp + fn AS positives, ROUND({d0("tp + tn", "tp + fp + fn + tn")}, 6) AS accuracy,
  ROUND({d0("tp", "tp + fp")}, 6) AS precision, ROUND({d0("tp", "tp + fn")}, 6) AS recall,
  ROUND({d0(f"2 * ({d0('tp', 'tp + fp')}) * ({d0('tp', 'tp + fn')})", f"({d0('tp', 'tp + fp')}) + ({d0('tp', 'tp + fn')})")}, 6) AS f1,
  ROUND({d0("tp + fn", "tp + fp + fn + tn")}, 6) AS fraud_rate, ROUND({AUC_EXPR}, 6) AS auc FROM k""")
def q_classification_metrics(spark, sf):
    return MT.classification_metrics(_scored(spark, sf))


@register("confusion_matrix", CELLS + """
SELECT 1 AS label, 1 AS prediction, tp AS n FROM k UNION ALL SELECT 0, 1, fp FROM k
UNION ALL SELECT 1, 0, fn FROM k UNION ALL SELECT 0, 0, tn FROM k""")
def q_confusion_matrix(spark, sf):
    return MT.confusion_matrix(_scored(spark, sf))


@register("class_report", CELLS + f"""
SELECT 1 AS class, ROUND({d0("tp", "tp + fp")}, 6) AS precision, ROUND({d0("tp", "tp + fn")}, 6) AS recall,
  ROUND({d0(f"2 * ({d0('tp', 'tp + fp')}) * ({d0('tp', 'tp + fn')})", f"({d0('tp', 'tp + fp')}) + ({d0('tp', 'tp + fn')})")}, 6) AS f1,
  tp + fn AS support FROM k
UNION ALL
SELECT 0, ROUND({d0("tn", "tn + fn")}, 6), ROUND({d0("tn", "tn + fp")}, 6),
  ROUND({d0(f"2 * ({d0('tn', 'tn + fn')}) * ({d0('tn', 'tn + fp')})", f"({d0('tn', 'tn + fn')}) + ({d0('tn', 'tn + fp')})")}, 6),
  tn + fp FROM k""")
def q_class_report(spark, sf):
    return MT.class_report(_scored(spark, sf))
