"""Exact per-key ordered quantities (gaps between consecutive events, value changes, gap
sessions) that stay parallel when one key holds a large share of all rows.

Rows are shuffled once, by (key, time bucket), and ordered inside each bucket by one window
pass; a (key, bucket) with more than ``HOT_ROWS`` rows is cut into slices of about as many rows.
Finding such pairs takes a counting job when the operator is built.  Everything that crosses a bucket edge is settled on small tables of one row per
(key, bucket) or per session piece, using the first and last row of each bucket.  No step
sends all rows of a key to one task and no row-level join follows the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ranks import running
from riskloom.session import stored

DEFAULT_BUCKET_US = 3600 * 1_000_000
US = 1_000_000


# A (key, bucket) with more rows than this is cut into slices of about as many rows, one instant included.
HOT_ROWS = 4_000_000
SUB_BITS = 20


def _bucket_ids(rows: DataFrame, key: str, order: list[str], bucket_us: int, hot_rows: int) -> DataFrame:
    """``_bucket``: a per-key BIGINT, monotone in the order columns (time first): the coarse time bucket and a slice in it.

    Slices hold about ``hot_rows`` rows, never twice as many: the order values (time and tiebreaks) of a pair with more rows than that are
    counted, and their running count over written ranges gives the cut points.  Order values that more rows share
    than fit a slice are dealt out over as many slices; such rows are equal in the order, so it is kept, and all edge logic stays
    exact.  The table of cut points has a row per pair that is cut and at most total / hot_rows
    points; it is stored, so that Spark checks its size before it broadcasts it.  Without such a pair there is nothing to join."""
    rows = rows.withColumn("_coarse", F.floor(F.col(order[0]) / F.lit(bucket_us)))
    large = stored(rows.groupBy(key, "_coarse").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot_rows).select(key, "_coarse"), "hot-hours")
    if large.limit(1).count() == 0:
        return rows.withColumn("_bucket", F.col("_coarse") * F.lit(1 << SUB_BITS)).drop("_coarse")
    at = F.struct(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(order)])
    pair = [F.col(f"`{key}`").eqNullSafe(F.col("_lk")) & (F.col("_coarse") == F.col("_lc"))]
    counted = rows.join(large.select(F.col(f"`{key}`").alias("_lk"), F.col("_coarse").alias("_lc")), pair, "left_semi") \
        .groupBy(F.col(f"`{key}`").alias("_k"), "_coarse", at.alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    counted = running(counted, [F.col("_k"), F.col("_coarse"), F.col("_at")], {"_upto": "_c"})
    # the running count passes over other pairs too; a slice is a multiple of hot_rows that it enters
    slice_of = lambda n: F.floor((n - 1) / F.lit(hot_rows))
    counted = counted.withColumn("_s", slice_of(F.col("_upto"))).withColumn("_over", F.col("_s") - slice_of(F.col("_upto") - F.col("_c") + 1))
    first = counted.groupBy("_k", "_coarse", "_s").agg(F.min(F.struct("_at", "_over")).alias("_f"))
    base = F.min(F.col("_s") - F.col("_f._over")).over(Window.partitionBy("_k", "_coarse"))
    first = first.select("_k", "_coarse", F.struct(F.col("_f._at").alias("at"), (F.col("_s") - base).alias("s"), F.col("_f._over").alias("over")).alias("_cut"))
    cuts = stored(first.groupBy("_k", "_coarse").agg(F.array_sort(F.collect_list("_cut")).alias("_cuts")).withColumnRenamed("_coarse", "_kc"), "cuts")
    joined = rows.join(cuts, F.col(f"`{key}`").eqNullSafe(F.col("_k")) & (F.col("_coarse") == F.col("_kc")), "left")
    joined = joined.withColumn("_cut", F.try_element_at(F.filter("_cuts", lambda c: c["at"] <= at), F.lit(-1)))
    shared = (F.col("_cut.at") == at) & (F.col("_cut.over") > 1)
    back = F.when(shared, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_cut.over"))).otherwise(0)
    sub = F.when(F.col("_cut").isNotNull(), F.col("_cut.s") - back).otherwise(0)
    return joined.withColumn("_bucket", F.col("_coarse") * F.lit(1 << SUB_BITS) + sub).drop("_coarse", "_cuts", "_cut", "_k", "_kc")


def bucketed(df: DataFrame, key: str, us: str, tiebreak: list[str] = (), cols: list[str] = (),
             bucket_us: int = DEFAULT_BUCKET_US, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, list[str]]:
    """Rows with ``_bucket``, the in-bucket previous time ``_lag_us`` and previous values
    ``_lag_<c>`` (NULL on a bucket's first row).  Rows with NULL ``us`` are dropped."""
    order = [us, *tiebreak]
    rows = _bucket_ids(df.where(F.col(us).isNotNull()), key, order, bucket_us, hot_rows)
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    return rows.select("*", F.lag(us).over(w).alias("_lag_us"),
                       *[F.lag(c).over(w).alias(f"_lag_{c}") for c in cols]), order


def gap_moments(df: DataFrame, key: str, us: str, tiebreak: list[str] = (),
                bucket_us: int = DEFAULT_BUCKET_US, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per key: n, min/max time, and count, mean and sum of squared deviations of the gaps
    (seconds) between consecutive times.

    Each bucket gives the count, mean and deviations of its own gaps, and one gap to the bucket
    before; the parts are merged around the key's mean, so nearly equal gaps lose no digits."""
    rows, _ = bucketed(df, key, us, tiebreak, (), bucket_us, hot_rows)
    g = (F.col(us) - F.col("_lag_us")).cast("double") / US
    per_bucket = rows.groupBy(key, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.min(us).alias("_min"), F.max(us).alias("_max"),
        F.count(g).alias("_m"), F.coalesce(F.avg(g), F.lit(0.0)).alias("_mean"),
        (F.coalesce(F.var_pop(g), F.lit(0.0)) * F.count(g)).alias("_dev"))
    by_key = Window.partitionBy(key)
    edge = (F.col("_min") - F.lag("_max").over(by_key.orderBy("_bucket"))).cast("double") / US
    per_bucket = per_bucket.withColumn("_edge", edge)
    gaps = F.sum("_m").over(by_key) + F.count("_edge").over(by_key)
    total = F.sum(F.col("_m") * F.col("_mean")).over(by_key) + F.coalesce(F.sum("_edge").over(by_key), F.lit(0.0))
    per_bucket = per_bucket.withColumn("_grand", total / F.when(gaps > 0, gaps))
    off, edge_off = F.col("_mean") - F.col("_grand"), F.col("_edge") - F.col("_grand")
    return per_bucket.groupBy(key).agg(
        F.sum("_n").alias("n"), F.min("_min").alias("min_us"), F.max("_max").alias("max_us"),
        (F.sum("_m") + F.count("_edge")).alias("gaps"), F.max("_grand").alias("gap_mean"),
        F.sum(F.col("_dev") + F.col("_m") * off * off + F.coalesce(edge_off * edge_off, F.lit(0.0))).alias("gap_dev"))


def change_counts(df: DataFrame, key: str, us: str, cols: list[str], tiebreak: list[str] = (),
                  bucket_us: int = DEFAULT_BUCKET_US, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per key and column: number of rows whose value differs (NULL-safe) from the previous
    row's value in time order."""
    rows, order = bucketed(df, key, us, tiebreak, cols, bucket_us, hot_rows)
    inner = [F.count(F.when(F.col("_lag_us").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_lag_{c}")), 1)).alias(f"_in_{c}")
             for c in cols]
    first = F.min(F.struct(*[F.col(o) for o in order], *[F.col(c).alias(f"v_{c}") for c in cols]))
    last = F.max(F.struct(*[F.col(o) for o in order], *[F.col(c).alias(f"v_{c}") for c in cols]))
    per_bucket = rows.groupBy(key, "_bucket").agg(*inner, first.alias("_first"), last.alias("_last"))
    prev = F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket"))
    per_bucket = per_bucket.select(key, *[F.col(f"_in_{c}") for c in cols], "_first", prev.alias("_prev"))
    edge = [F.count(F.when(F.col("_prev").isNotNull() & ~F.col("_first")[f"v_{c}"].eqNullSafe(F.col("_prev")[f"v_{c}"]), 1))
            for c in cols]
    return per_bucket.groupBy(key).agg(*[(F.sum(f"_in_{c}") + e).alias(c) for c, e in zip(cols, edge)])


def session_pieces(df: DataFrame, key: str, us: str, gap_limit_us: int, tiebreak: list[str] = (),
                   extra_sums: dict | None = None, bucket_us: int = DEFAULT_BUCKET_US,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Gap sessions (a gap longer than ``gap_limit_us`` starts a new one) per key, one row per
    session: start, end, rows, and the sums of ``extra_sums`` {name: column expression}.

    Inside a bucket, runs split at long gaps (one window pass); runs are merged across bucket
    edges by a window over the run table (one row per session piece, far fewer than rows)."""
    extra_sums = extra_sums or {}
    rows, order = bucketed(df, key, us, tiebreak, (), bucket_us, hot_rows)
    w = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(((F.col(us) - F.col("_lag_us")) > gap_limit_us).cast("int"), F.lit(0))
    rows = rows.withColumn("_run", F.sum(start).over(w))
    pieces = rows.groupBy(key, "_bucket", "_run").agg(
        F.min(us).alias("_s"), F.max(us).alias("_e"), F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_x_{k}") for k, c in extra_sums.items()])
    wk = Window.partitionBy(key).orderBy("_bucket", "_run")
    new = F.coalesce(((F.col("_s") - F.lag("_e").over(wk)) > gap_limit_us).cast("int"), F.lit(1))
    pieces = pieces.withColumn("_new", new)
    pieces = pieces.withColumn("_sid", F.sum("_new").over(wk.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy(key, "_sid").agg(
        F.min("_s").alias("start_us"), F.max("_e").alias("end_us"), F.sum("_n").alias("n"),
        *[F.sum(f"_x_{k}").alias(k) for k in extra_sums])
