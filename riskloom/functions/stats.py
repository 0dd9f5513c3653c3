"""Statistic and time expressions shared by the feature operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Microseconds since the epoch, independent of the session time zone for NTZ values."""
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(dtype, T.DateType):
        col = col.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), col)


def epoch_seconds(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Whole epoch seconds (floor), as BIGINT."""
    return F.floor(epoch_micros(c, dtype) / F.lit(1_000_000)).cast("bigint")


def sample_skew(c: Column) -> Column:
    """Adjusted sample skewness G1 (NULL for n<3, 0 for a constant group)."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    adj = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(adj, F.lit(0.0)))


def sample_kurt(c: Column) -> Column:
    """Unbiased excess kurtosis G2 (NULL for n<4, 0 for a constant group)."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    adj = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.coalesce(adj, F.lit(0.0)))


def quantile(c: Column, q: float, approx: bool = False, accuracy: int = 10000) -> Column:
    """Linear-interpolated quantile; ``approx`` switches to a bounded-memory sketch."""
    if approx:
        return F.percentile_approx(c, q, accuracy).cast("double")
    return F.percentile(c, F.lit(q))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def round_doubles(df, places: int = 6):
    """Round every DOUBLE/FLOAT column (used by the query catalogue for comparison)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), places).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
