"""Exact quantiles per group (linear interpolation between the order statistics at
floor/ceil of (n-1)·q) that never hold a whole group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer, so a key
with a third of all rows, or a global quantile, lands in one task.  Instead:

  1. count rows per (group, value) with map-side combine; a hot group spreads over tasks
     by value; the counts are written once, and the other steps read them;
  2. give every value an order-preserving bucket (log scale, 1/1024 of an octave wide);
     counts per (group, bucket) form a small table whose running sums give the first
     rank of every bucket;
  3. the wanted ranks fall into at most 2·len(qs) buckets per group; each of these is cut
     evenly into 4,096 parts and counted again, so that a column of narrow range does not
     end in one bucket;
  4. only the distinct values of the parts that hold a wanted rank are ranked (one window per
     part) and the two order statistics around each position are interpolated.

NULL and NaN values are skipped; a group without values gets no row (NULL after a join).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import stored

STEPS_PER_OCTAVE = 1024
# Even parts of a bucket in the second step.
PARTS = 4096
# |log2| of finite doubles is below 1075, so positive and negative buckets stay apart.
OFFSET = 1 << 21
TOP = 1 << 23


def order_bucket(v: Column) -> Column:
    """Monotone (non-decreasing) BIGINT bucket of a double."""
    mag = F.floor(F.log2(F.abs(v)) * F.lit(float(STEPS_PER_OCTAVE)))
    return (F.when(v == 0, F.lit(0)).when(v == float("inf"), F.lit(TOP)).when(v == float("-inf"), F.lit(-TOP))
            .when(v > 0, mag + OFFSET).otherwise(-(mag + OFFSET))).cast("bigint")


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _long(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    if len(values) == 1:
        x = df.select(*keys, F.lit(0).alias("_c"), _q(values[0]).cast("double").alias("_v"))
    else:
        kv = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), _q(c).cast("double").alias("_v"))
                                 for i, c in enumerate(values)])).alias("_kv")
        x = df.select(*keys, kv).select(*keys, "_kv._c", "_kv._v")
    return x.where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def quantiles_long(df: DataFrame, keys: list[str], values: list[str], qs: list[float]) -> DataFrame:
    """Rows (keys..., _c, _q0, _q1, ...): column index ``_c`` into ``values``, one column per q."""
    counts = _long(df, keys, values).groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return quantiles_of_counts(stored(counts, "value-counts"), keys, qs)


def quantiles_of_counts(counts: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """``quantiles_long`` from counted values (keys..., _c, _v, _n), which several steps read: pass them stored."""
    g = [*keys, "_c"]
    counts = counts.withColumn("_b", order_bucket(F.col("_v")))
    pos = [(F.col("_total") - 1).cast("double") * F.lit(q) for q in qs]
    ranks = F.array(*[r for p in pos for r in (F.floor(p), F.ceil(p))])

    def holding(rows: DataFrame, by: list[str], before: Column, total: Column) -> DataFrame:
        """The buckets ``by`` + _b that hold a wanted rank, with the rows before them."""
        per = rows.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max(before).alias("_base"), F.max(total).alias("_given"))
        run = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        per = per.select(*by, "_b", "_bn", "_lo", "_hi", (F.col("_base") + F.sum("_bn").over(run) - F.col("_bn")).alias("_before"),
                         F.coalesce("_given", F.sum("_bn").over(Window.partitionBy(*by))).alias("_total"))
        return per.where(F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_bn"))))

    # a target bucket may still hold most of a narrow column: it is cut again, evenly between its ends
    first = stored(holding(counts, g, F.lit(0), F.lit(None).cast("long")), "target-buckets")  # a few rows per group, read twice
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1))).otherwise(0)
    inner = counts.join(first.drop("_bn"), [*g, "_b"]).withColumn("_outer", F.col("_b")).withColumn("_b", part.cast("bigint"))
    counts, g = inner.drop("_lo", "_hi", "_before", "_total"), [*g, "_outer"]
    targets = holding(inner, g, F.col("_before"), F.col("_total")).select(*g, "_b", "_before", "_total")
    within = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.join(targets, [*g, "_b"]).select(
        *g, "_v", "_total", (F.col("_before") + F.sum("_n").over(within)).alias("_end"), "_n")
    start = F.col("_end") - F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= start) & (rank < F.col("_end")), F.col("_v")))

    n1 = (F.col("_total") - 1).cast("double")
    aggs = []
    for j, q in enumerate(qs):
        p = n1 * F.lit(q)
        lo, hi, frac = at(F.floor(p)), at(F.ceil(p)), F.max(p - F.floor(p))
        aggs.append(F.when(frac == 0, lo).otherwise((1 - frac) * lo + frac * hi).alias(f"_q{j}"))
    return ranked.groupBy(*keys, "_c").agg(*aggs)


def wide(lq: DataFrame, keys: list[str], values: list[str], qs: list[float], name: Callable[[str, float], str]) -> DataFrame:
    """The rows of ``quantiles_long`` as a column ``name(value, q)`` per value column and q."""
    if len(values) == 1:
        return lq.select(*keys, *[F.col(f"_q{j}").alias(name(values[0], q)) for j, q in enumerate(qs)])
    cols = [F.max(F.when(F.col("_c") == i, F.col(f"_q{j}"))).alias(name(c, q))
            for i, c in enumerate(values) for j, q in enumerate(qs)]
    return lq.groupBy(*keys).agg(*cols) if keys else lq.agg(*cols)


def exact_quantiles(df: DataFrame, keys: list[str], values: list[str], qs: list[float],
                    name: Callable[[str, float], str] = lambda c, q: f"{c}_q{q}") -> DataFrame:
    """One row per group of ``keys`` with a column ``name(value, q)`` per value column and q."""
    return wide(quantiles_long(df, keys, values, qs), keys, values, qs, name)
