"""Binary classification metrics computed as DataFrame aggregates.

Cumulative counts in score order (ROC, PR, AP) never sort all rows in one task: one row per
distinct score with positive / negative counts (map-side combine), written once, then running
sums over score ranges (``ranks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranks import running
from riskloom.session import cut_lineage


def score_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rows without a score (NULL or NaN) or label take no part."""
    s = F.col(score).cast("double")
    return df.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).groupBy(s.alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) != 1, 1)).alias("neg"))


def cumulative_from_top(counts: DataFrame) -> DataFrame:
    """Adds tp / fp = positives / negatives with score >= this score (exact)."""
    return running(counts, [F.col("score").desc()], {"tp": "pos", "fp": "neg"})


def _totals(counts: DataFrame):
    r = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    return int(r["P"] or 0), int(r["N"] or 0)


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score threshold: tp, fp, precision, recall."""
    counts = cut_lineage(score_counts(df, score, label))
    cum = cumulative_from_top(counts)
    P, _ = _totals(counts)
    return cum.select(F.col("score").alias("threshold"), "tp", "fp",
                      (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                      (F.col("tp") / F.lit(P) if P else F.lit(0.0)).alias("recall"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Step-sum AP = sum over thresholds of (recall step) * precision; 0 without positives."""
    counts = cut_lineage(score_counts(df, score, label))
    cum = cumulative_from_top(counts)
    P, _ = _totals(counts)
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return cum.agg((steps / F.lit(P) if P else F.lit(0.0)).alias("average_precision"))


def threshold_at_precision(df: DataFrame, min_precision: float = 0.8, score: str = "score",
                           label: str = "label") -> DataFrame:
    """Lowest threshold whose precision reaches ``min_precision`` and the recall there
    (NULL threshold and recall 0 when none does)."""
    curve = pr_curve(df, score, label)
    ok = curve.where(F.col("precision") >= min_precision)
    best = F.min(F.struct(F.col("threshold").alias("t"), F.col("recall").alias("r")))
    return ok.agg(best.alias("b")).select(F.col("b.t").alias("threshold"), F.coalesce(F.col("b.r"), F.lit(0.0)).alias("recall"))


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact ROC AUC with ties counted one half (rank-sum form)."""
    counts = cut_lineage(score_counts(df, score, label))
    cum = cumulative_from_top(counts)
    P, N = _totals(counts)
    below = F.lit(N) - F.col("fp")  # negatives strictly below this score
    s = F.sum(F.col("pos") * below + 0.5 * F.col("pos") * F.col("neg"))
    return cum.agg((s / F.lit(P * N) if P and N else F.lit(None).cast("double")).alias("auc"))


def _cells(df: DataFrame, score: str, label: str, threshold: float):
    df = df.where(~F.isnan(F.col(score).cast("double")))
    pred = (F.col(score) > threshold).cast("int")
    y = F.col(label)
    return df.agg(F.count(F.when((y == 1) & (pred == 1), 1)).alias("tp"), F.count(F.when((y == 0) & (pred == 1), 1)).alias("fp"),
                  F.count(F.when((y == 1) & (pred == 0), 1)).alias("fn"), F.count(F.when((y == 0) & (pred == 0), 1)).alias("tn"))


def _div0(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def classification_metrics(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: n, positives, accuracy, precision, recall, F1 (0 when undefined), AUC, fraud rate."""
    c = _cells(df, score, label, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    prec, rec = _div0(tp, tp + fp), _div0(tp, tp + fn)
    m = c.select(n.alias("n"), (tp + fn).alias("positives"), _div0(tp + tn, n).alias("accuracy"), prec.alias("precision"),
                 rec.alias("recall"), _div0(2 * prec * rec, prec + rec).alias("f1"), _div0(tp + fn, n).alias("fraud_rate"))
    a = auc(df, score, label).first()["auc"]
    return m.withColumn("auc", F.lit(a).cast("double"))


def confusion_matrix(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    c = _cells(df, score, label, threshold)
    cells = [(1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")]
    return c.select(F.explode(F.array(*[F.struct(F.lit(y).alias("label"), F.lit(p).alias("prediction"), F.col(k).alias("n"))
                                        for y, p, k in cells])).alias("c")).select("c.*")


def class_report(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Per class: precision, recall, F1, support."""
    c = _cells(df, score, label, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rows = []
    for cls, t, f_p, f_n in ((1, tp, fp, fn), (0, tn, fn, fp)):
        p, r = _div0(t, t + f_p), _div0(t, t + f_n)
        rows.append(F.struct(F.lit(cls).alias("class"), p.alias("precision"), r.alias("recall"),
                             _div0(2 * p * r, p + r).alias("f1"), (t + f_n).alias("support")))
    return c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
