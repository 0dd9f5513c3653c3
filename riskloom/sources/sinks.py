"""Sinks: predictions (CSV and Parquet), describe tables, report rows as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str, csv: bool = True) -> None:
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    if csv:
        df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(f"{path}/csv")


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows (section_no, section, ord, line) as one text file; reports are tens of rows,
    so a single ordered partition is bounded."""
    rows.orderBy("section_no", "ord").select(F.col("line").alias("value")).coalesce(1) \
        .write.mode("overwrite").text(path)


def write_prediction_base(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
