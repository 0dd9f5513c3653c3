"""Running sums over a global order without sorting all rows in one task.

The rows are range-partitioned by the order and written, so that a retried task sees the same
ranges; every range is summed (one row per range comes to the driver), and the running sum inside
a range starts from the ranges before it.  Pass one row per distinct order value: equal values share
a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds ``out`` = sum of column ``c`` up to and including the row, per {out: c}."""
    rows = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = rows.groupBy("_range").agg(*[F.sum(c).alias(out) for out, c in sums.items()]).orderBy("_range").collect()
    before, offsets = dict.fromkeys(sums, 0), []
    for r in totals:  # one row per range
        offsets.append((r["_range"], *before.values()))
        before = {out: before[out] + (r[out] or 0) for out in sums}
    table = df.sparkSession.createDataFrame(offsets, "_range int, " + ", ".join(f"`_o_{out}` long" for out in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # as many rows as ranges: small enough to broadcast
    return rows.join(F.broadcast(table), "_range").select(
        *df.columns, *[(F.col(f"_o_{out}") + F.sum(c).over(inside)).alias(out) for out, c in sums.items()])
