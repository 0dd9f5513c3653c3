"""Label-table operators: distribution, class balance, balanced class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import stored

BALANCED_MIN_SHARE = 0.3  # fixed value


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share per label value, with the overall label mean on every row."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # the label table has a handful of classes: a global window over these rows is tiny
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("label", "n", (F.col("n") / total).alias("share"),
                         (F.sum(F.col("label") * F.col("n")).over(Window.partitionBy()) / total).alias("label_mean"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: classes, min/max class count, minority share, balanced flag (two classes)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_count"), F.max("n").alias("max_count"),
        (F.min("n") / F.sum("n")).alias("minority_share"), (F.min("n") / F.max("n")).alias("min_max_ratio"),
    ).withColumn("is_balanced", ((F.col("n_classes") == 2) & (F.col("minority_share") >= BALANCED_MIN_SHARE)).cast("int"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select("label", "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (the weight table has one row per class; it is
    stored, so that Spark checks its size before it broadcasts it)."""
    weights = class_weights(df, label).select(F.col("label").alias(label), F.col("weight").alias(out))
    return df.join(stored(weights, "class-weights"), label, "left")
