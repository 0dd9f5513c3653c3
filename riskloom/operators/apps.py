"""Application features: per-key numeric, date and category statistics (several rows per
key), per-row value features (no key), and encoded categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.stats import epoch_micros
from riskloom.functions.text import digit_count, has_special, letter_count
from riskloom.operators.events import KEY, keyed
from riskloom.operators.ranks import running
from riskloom.session import stored

US = 1_000_000


def app_numeric_stats(df: DataFrame, key: str | None = None, prefix: str = "app") -> DataFrame:
    rows, roles, _ = keyed(df, key)
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_records_count")]
    for c in roles["numeric"]:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{prefix}_{c}_mean"), F.stddev_samp(x).alias(f"{prefix}_{c}_std"),
                 F.max(x).alias(f"{prefix}_{c}_max"), F.min(x).alias(f"{prefix}_{c}_min")]
    return rows.groupBy(KEY).agg(*aggs)


def app_date_stats(df: DataFrame, key: str | None = None, prefix: str = "app") -> DataFrame:
    """Per date/timestamp column: mean/min/max epoch seconds, mean hour, weekday (Mon=0), month."""
    rows, roles, types = keyed(df, key)
    aggs = []
    for c in roles["time"]:
        ts = F.col(c).cast("timestamp_ntz") if types[c].typeName() == "date" else F.col(c)
        secs = F.floor(epoch_micros(ts) / F.lit(US))
        aggs += [F.avg(secs).alias(f"{prefix}_{c}_timestamp_mean"),
                 F.min(secs).alias(f"{prefix}_{c}_timestamp_min"), F.max(secs).alias(f"{prefix}_{c}_timestamp_max"),
                 F.avg(F.hour(ts)).alias(f"{prefix}_{c}_hour_mean"),
                 F.avg(F.weekday(ts)).alias(f"{prefix}_{c}_day_of_week_mean"),
                 F.avg(F.month(ts)).alias(f"{prefix}_{c}_month_mean")]
    return rows.groupBy(KEY).agg(*aggs)


def app_category_counts(df: DataFrame, key: str | None = None, prefix: str = "app") -> DataFrame:
    """Distinct non-NULL values per key and string column: one shuffle on (key, column,
    value) with map-side combine, then one conditional count per key (no distinct expansion)."""
    rows, roles, _ = keyed(df, key)
    cols = roles["string"]
    long = rows.select(KEY, F.explode(F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("val")) for i, c in enumerate(cols)
    ])).alias("kv")).select(KEY, "kv.col", "kv.val").where(F.col("val").isNotNull())
    distinct = long.groupBy(KEY, "col", "val").agg(F.lit(1).alias("_x"))
    return distinct.groupBy(KEY).agg(*[
        F.count(F.when(F.col("col") == i, 1)).alias(f"{prefix}_{c}_unique_count") for i, c in enumerate(cols)])


def app_features(df: DataFrame, key: str | None = None, prefix: str = "app") -> DataFrame:
    """Group path of the application table: counts, numeric, date and category statistics."""
    parts = [app_numeric_stats(df, key, prefix)]
    _, roles, _ = keyed(df, key)
    if roles["time"]:
        parts.append(app_date_stats(df, key, prefix))
    if roles["string"]:
        parts.append(app_category_counts(df, key, prefix))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, KEY, "left")
    if roles["string"]:
        out = out.fillna(0, [f"{prefix}_{c}_unique_count" for c in roles["string"]])
    return out


def row_text_features(df: DataFrame, row_key: str, prefix: str = "app") -> DataFrame:
    """No-key path: one output row per input row.  Numbers pass through; every string gives
    length, digit count, letter count and a has-special flag; dates give nothing."""
    cols = [F.col(row_key).alias(KEY)]
    for f in df.schema.fields:
        if f.name == row_key:
            continue
        c = F.col(f"`{f.name}`")
        if S.is_numeric(f.dataType):
            cols.append(c.alias(f"{prefix}_{f.name}"))
        elif S.is_string(f.dataType):
            cols += [F.length(c).cast("bigint").alias(f"{prefix}_{f.name}_length"),
                     digit_count(c).alias(f"{prefix}_{f.name}_digit_count"),
                     letter_count(c).alias(f"{prefix}_{f.name}_alpha_count"),
                     has_special(c).alias(f"{prefix}_{f.name}_has_special")]
    return df.select(*cols)


def encode_categories(df: DataFrame, cols: list[str], key: str | None = None,
                      ratio: tuple[str, str] | None = None, prefix: str = "app") -> DataFrame:
    """Dense integer codes (1-based, by sorted value) for string columns, plus an optional
    numerator/denominator ratio (NULL when the denominator is 0 or NULL).

    The code table has one row per distinct value, ranked over value ranges (``ranks``) and stored, so
    that Spark broadcasts it while it is small and otherwise shuffles both sides of the join."""
    out = df
    for c in cols:
        values = df.select(c).where(F.col(c).isNotNull()).distinct().withColumn("_one", F.lit(1))
        codes = running(values, [F.col(c)], {"_code": "_one"})
        out = out.join(stored(codes.select(c, F.col("_code").cast("int").alias(f"{prefix}_{c}_code")), "codes"), c, "left")
    if ratio:
        num, den = ratio
        out = out.withColumn(f"{prefix}_{num}_to_{den}_ratio",
                             F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")))
    return out
