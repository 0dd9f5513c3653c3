"""Data quality and cleaning: one profiling aggregate over all columns, warning rules,
describe, numeric/constant column tests, type coercion, cleaning, median imputation and
standardisation.

Column decisions that depend on data (constant columns, numeric-like strings) take one aggregate
job whose one-row result is read on the driver; the cleaned table is then one lazy projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schema as S
from riskloom.functions.stats import epoch_seconds, quantile
from riskloom.operators import quantiles as QT

# Warning rules (name, profile field, comparison, threshold).
WARNING_RULES = [
    ("fraud_rate_below_1pct", "fraud_rate", "<", 0.01),
    ("fraud_rate_below_5pct", "fraud_rate", "<", 0.05),
    ("fraud_rate_above_50pct", "fraud_rate", ">", 0.5),
    ("missing_above_20pct", "missing_ratio", ">", 0.2),
    ("missing_above_30pct", "missing_ratio", ">", 0.3),
    ("class_balance_below_10pct", "minority_share", "<", 0.1),
]
HIGH_NULL_SHARE = 0.5
# Bookkeeping columns dropped from merged data.
BOOKKEEPING_PREFIXES = ("source_",)
BOOKKEEPING_SUFFIXES = ("_target",)
BOOKKEEPING_NAMES = ("original_filename", "file_path")


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def _is_float(dt) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def _is_inf(c: Column) -> Column:
    return c.isin(float("inf"), float("-inf"))


def quality_profile(df: DataFrame, label: str | None = None) -> DataFrame:
    """One row: rows, feature columns, numeric / category columns, NULL cells, missing ratio,
    infinite cells, constant columns, columns with > 50 % NULL, label counts, fraud rate and
    minority share.  One aggregate pass."""
    fields = [f for f in df.schema.fields if f.name != label]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        aggs += [F.count(q(f.name)).alias(f"_c{i}"), F.min(q(f.name)).alias(f"_lo{i}"), F.max(q(f.name)).alias(f"_hi{i}")]
        if _is_float(f.dataType):
            aggs.append(F.count(F.when(_is_inf(q(f.name)) | F.isnan(q(f.name)), 1)).alias(f"_inf{i}"))
    if label:
        aggs += [F.count(F.when(q(label) == 1, 1)).alias("_pos"), F.count(F.when(q(label) == 0, 1)).alias("_neg"),
                 F.avg(q(label).cast("double")).alias("_rate")]
    a = df.agg(*aggs)
    n = F.col("_n")
    k = len(fields)
    nulls = sum((n - F.col(f"_c{i}") for i in range(k)), F.lit(0))
    consts = sum((F.coalesce((F.col(f"_lo{i}") == F.col(f"_hi{i}")), F.lit(True)).cast("int") for i in range(k)), F.lit(0))
    high_null = sum(((n - F.col(f"_c{i}")) > n * HIGH_NULL_SHARE).cast("int") for i in range(k)) if k else F.lit(0)
    infs = sum((F.col(f"_inf{i}") for i, f in enumerate(fields) if _is_float(f.dataType)), F.lit(0))
    cols = [
        n.alias("n_rows"), F.lit(k).cast("bigint").alias("n_columns"),
        F.lit(sum(S.is_numeric(f.dataType) for f in fields)).cast("bigint").alias("numeric_columns"),
        F.lit(sum(S.is_string(f.dataType) for f in fields)).cast("bigint").alias("category_columns"),
        nulls.cast("bigint").alias("null_cells"),
        F.try_divide(nulls.cast("double"), (n * k).cast("double")).alias("missing_ratio"),
        infs.cast("bigint").alias("inf_cells"), consts.cast("bigint").alias("constant_columns"),
        high_null.cast("bigint").alias("high_null_columns"),
    ]
    if label:
        cols += [F.col("_pos").alias("positive_count"), F.col("_neg").alias("negative_count"),
                 F.col("_rate").alias("fraud_rate"),
                 F.when((F.col("_pos") > 0) & (F.col("_neg") > 0),
                        F.least("_pos", "_neg") / (F.col("_pos") + F.col("_neg"))).alias("minority_share")]
    return a.select(*cols)


def quality_warnings(profile: DataFrame) -> DataFrame:
    """Warning rules over a profile row -> rows (rule, value, threshold, fired)."""
    rows = []
    for name, field, op, thr in WARNING_RULES:
        if field not in profile.columns:
            continue
        v = F.col(field).cast("double")
        fired = (v < thr) if op == "<" else (v > thr)
        rows.append(F.struct(F.lit(name).alias("rule"), v.alias("value"), F.lit(thr).alias("threshold"),
                             F.coalesce(fired, F.lit(False)).cast("int").alias("fired")))
    return profile.select(F.explode(F.array(*rows)).alias("w")).select("w.*")


# What counts as a number in text. Spark's cast also takes the suffixes of Java literals (12D,
# 7F); testing the pattern first leaves those out and avoids a failed parse per text value.
NUMBER = r"^[\x00-\x20]*(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity)|(?i:nan))[\x00-\x20]*$"


def parse_number(c: Column) -> Column:
    """Double of a text that is a number, NULL otherwise."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def column_profile(df: DataFrame) -> DataFrame:
    """Rows (column, kind, non_null, is_constant, is_numeric_like) from one aggregate pass.

    ``is_numeric_like``: numeric columns, and string columns where every non-NULL value casts
    to a number and at least one value exists."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        aggs += [F.count(q(f.name)).alias(f"_c{i}"), F.min(q(f.name)).alias(f"_lo{i}"), F.max(q(f.name)).alias(f"_hi{i}")]
        if S.is_string(f.dataType):
            bad = q(f.name).isNotNull() & parse_number(q(f.name)).isNull()
            aggs.append(F.max(bad.cast("int")).alias(f"_bad{i}"))
    a = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        kind = ("numeric" if S.is_numeric(f.dataType) else "time" if S.is_time(f.dataType)
                else "string" if S.is_string(f.dataType) else "other")
        if kind == "numeric":
            numeric_like = F.lit(True)
        elif kind == "string":
            numeric_like = (F.col(f"_c{i}") > 0) & (F.col(f"_bad{i}") == 0)
        else:
            numeric_like = F.lit(False)
        rows.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(kind).alias("kind"),
                             F.col(f"_c{i}").alias("non_null"),
                             F.coalesce(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.lit(True)).cast("int").alias("is_constant"),
                             numeric_like.cast("int").alias("is_numeric_like")))
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def describe(df: DataFrame, cols: list[str] | None = None, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Per numeric column: count, mean, std, min, q25, median, q75, max.

    Algebraic statistics: one global aggregate with partial aggregation per input partition.
    Exact quartiles: the distributed order-statistic plan of ``quantiles`` (no task holds a
    whole column), joined on the column index; ``approx=True`` uses a bounded sketch."""
    cols = cols or [f.name for f in df.schema.fields if S.is_numeric(f.dataType)]
    qs = [0.25, 0.5, 0.75]
    aggs = []
    for i, c in enumerate(cols):
        v = q(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        if approx:
            aggs.append(F.percentile_approx(v, qs, accuracy).alias(f"p{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("_c"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"),
                     F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
                     *([F.col(f"p{i}")[j].cast("double").alias(f"_q{j}") for j in range(3)] if approx else []),
                     F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)]
    base = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if not approx:
        base = base.join(QT.quantiles_long(df, [], cols, qs), "_c", "left")
    return base.select("column_name", "count", "mean", "std", "min", F.col("_q0").alias("q25"),
                       F.col("_q1").alias("median"), F.col("_q2").alias("q75"), "max")


def datetime_to_epoch(df: DataFrame) -> DataFrame:
    """Time columns become ``<name>_timestamp`` epoch seconds; interval columns are dropped."""
    out = []
    for f in df.schema.fields:
        if S.is_time(f.dataType):
            out.append(epoch_seconds(q(f.name), f.dataType).alias(f"{f.name}_timestamp"))
        elif isinstance(f.dataType, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
            continue
        else:
            out.append(q(f.name))
    return df.select(*out)


def coerce_types(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Everything to numbers: time -> epoch seconds, day-time interval -> seconds, numbers
    pass, strings -> number or 0; other types dropped.  NULL, NaN and +-inf end as 0."""
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if f.name in keep:
            out.append(c)
        elif S.is_numeric(f.dataType):
            out.append(c)
        elif S.is_time(f.dataType):
            out.append(epoch_seconds(c, f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.DayTimeIntervalType):
            out.append((F.unix_micros(F.lit("1970-01-01").cast("timestamp") + c) / 1e6).alias(f.name))
        elif S.is_string(f.dataType):
            out.append(F.coalesce(parse_number(c), F.lit(0.0)).alias(f.name))
    return clean_numeric(df.select(*out), keep)


def filled(c: Column, kind: T.DataType) -> Column:
    """NULL, NaN and +-inf as 0."""
    if _is_float(kind) or S.is_string(kind):
        return F.when(_is_inf(c) | F.isnan(c) | c.isNull(), F.lit(0.0)).otherwise(c)
    return F.coalesce(c, F.lit(0))


def clean_numeric(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns: +-inf and NaN -> 0, NULL -> 0."""
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if f.name not in keep and S.is_numeric(f.dataType):
            out.append(filled(c, f.dataType).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def finite(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """+-inf -> 0 and NaN -> NULL in float columns; NULL stays, for a median imputer."""
    return df.select(*[F.when(_is_inf(q(f.name)), F.lit(0.0)).when(~F.isnan(q(f.name)), q(f.name)).alias(f.name)
                       if f.name not in keep and _is_float(f.dataType) else q(f.name) for f in df.schema.fields])


def drop_bookkeeping(df: DataFrame) -> DataFrame:
    drop = [c for c in df.columns if c.startswith(BOOKKEEPING_PREFIXES) or c.endswith(BOOKKEEPING_SUFFIXES)
            or c in BOOKKEEPING_NAMES]
    return df.drop(*drop)


def clean_merged(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Merged data clean-up: bookkeeping columns dropped, NULL numbers -> 0, NULL strings ->
    'unknown'."""
    df = drop_bookkeeping(df)
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if f.name in keep:
            out.append(c)
        elif S.is_numeric(f.dataType):
            out.append(F.coalesce(c, F.lit(0)).cast(f.dataType).alias(f.name))
        elif S.is_string(f.dataType):
            out.append(F.coalesce(c, F.lit("unknown")).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def clean_features(df: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Feature clean-up: time -> epoch seconds, numeric-like strings cast, other strings
    dropped, NULL/NaN/inf -> 0, constant columns dropped.  Returns the cleaned frame and the
    feature column list.

    One aggregate tests every text column and takes the range of every column as it will be
    once cast and filled: a column of one value and NULLs is not constant, NULL being 0 there."""
    x = datetime_to_epoch(df)
    candidates = [f for f in x.schema.fields if f.name not in keep and (S.is_numeric(f.dataType) or S.is_string(f.dataType))]
    as_number = x.select(*[q(k) for k in keep], *[
        (parse_number(q(f.name)) if S.is_string(f.dataType) else q(f.name)).alias(f.name) for f in candidates])
    cleaned = clean_numeric(as_number, keep)
    aggs = []
    for i, f in enumerate(candidates):
        value = filled(parse_number(q(f.name)) if S.is_string(f.dataType) else q(f.name), f.dataType)
        aggs += [F.min(value).alias(f"_lo{i}"), F.max(value).alias(f"_hi{i}")]
        if S.is_string(f.dataType):
            text = q(f.name).isNotNull()
            aggs += [F.max((text & parse_number(q(f.name)).isNull()).cast("int")).alias(f"_bad{i}"), F.count(q(f.name)).alias(f"_c{i}")]
    row = x.agg(*aggs).first().asDict() if aggs else {}
    features = [f.name for i, f in enumerate(candidates)
                if row[f"_lo{i}"] != row[f"_hi{i}"] and not row.get(f"_bad{i}", 0) and row.get(f"_c{i}", 1)]
    return cleaned.select(*[q(k) for k in keep], *[q(c) for c in features]), features


def impute_median(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """NULL -> column median (exact by default; ``approx`` uses a bounded sketch)."""
    cols = cols or [f.name for f in df.schema.fields if S.is_numeric(f.dataType)]
    if approx:
        med = df.agg(*[quantile(q(c).cast("double"), 0.5, True).alias(c) for c in cols]).first()
    else:  # one row read on the driver; the medians themselves are computed distributed
        med = QT.exact_quantiles(df, [], cols, [0.5], name=lambda c, _: c).first()
    return df.select(*[F.coalesce(q(f.name).cast("double"), F.lit(med[f.name])).alias(f.name) if f.name in cols
                       else q(f.name) for f in df.schema.fields])


def standardize(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(x - mean) / population std; zero variance gives 0.  One aggregate row read on the
    driver, then one projection with literals (no join)."""
    cols = cols or [f.name for f in df.schema.fields if S.is_numeric(f.dataType)]
    st = df.agg(*[F.avg(q(c)).alias(f"m_{c}") for c in cols], *[F.stddev_pop(q(c)).alias(f"s_{c}") for c in cols]).first()
    out = []
    for f in df.schema.fields:
        if f.name in cols:
            m, s = st[f"m_{f.name}"], st[f"s_{f.name}"]
            out.append((F.lit(0.0) if not s else (q(f.name) - F.lit(m)) / F.lit(s)).alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


def align_features(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of the trained list in its order; missing columns -> 0, extra ones dropped.  NULL in a
    column that is there stays NULL: the model's median imputer fills it."""
    have = set(df.columns)
    return df.select(*[q(k) for k in keep],
                     *[(q(c).cast("double") if c in have else F.lit(0.0)).alias(c) for c in features])


def training_gates(df: DataFrame, label: str, min_rows: int = 100) -> DataFrame:
    """One row of checks: enough rows, two label values, non-empty features, no NULL label."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"), F.count_distinct(q(label)).alias("n_labels"), F.count(q(label)).alias("labelled_rows"),
        (n >= min_rows).cast("int").alias("enough_rows"), (F.count_distinct(q(label)) >= 2).cast("int").alias("two_classes"),
        (F.count(q(label)) == n).cast("int").alias("aligned"))
