"""Per-key event features: counts, numeric statistics and moments, time intervals,
categorical statistics, temporal hour profile, sessions, activity and value changes.

Every operator is built from ``df.schema``; NaN counts as missing, like NULL. No rows are collected; building the
ordered operators and the exact quantiles runs the jobs that count hours and values.  Aggregates are
algebraic (partial aggregation before the shuffle); exact percentiles use the distributed
order-statistic plan of ``quantiles`` (``approx=True`` swaps in a bounded sketch).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions.stats import epoch_micros, quantile, sample_kurt, sample_skew
from riskloom.operators import ordered as O
from riskloom.operators import quantiles as Q
from riskloom.operators.ordered import DEFAULT_BUCKET_US
from riskloom.session import stored
from riskloom.sources.tables import nan_as_null

KEY = S.CANONICAL_KEY
US = 1_000_000
# Hour rules (night is h >= 22 or h <= 6, business 9..17) and weekend (Mon=0).
NIGHT_FROM, NIGHT_TO = 22, 6
BUSINESS_FROM, BUSINESS_TO = 9, 17
WEEKEND_FROM = 5
SESSION_GAP_MINUTES = 30


def keyed(df: DataFrame, key: str | None = None) -> tuple[DataFrame, dict[str, list[str]], dict]:
    """Rows with a non-NULL key renamed to ``application_id``; roles of the other columns."""
    key = key or S.group_key(df)
    if key is None:
        raise ValueError(f"no group key among {df.columns}")
    types = {f.name: f.dataType for f in df.schema.fields}
    roles = S.columns_by_role(df, exclude=(key,))
    out = nan_as_null(df.where(F.col(key).isNotNull())).withColumnRenamed(key, KEY)
    if KEY in roles["numeric"] or KEY in roles["string"] or KEY in roles["time"]:
        raise ValueError(f"column {KEY} exists besides the key")
    return out, roles, types


def _join_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, KEY, "left"), frames)


QUANTILE_STATS = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def numeric_stat_exprs(cols: list[str], prefix: str, approx: bool = False,
                       stats: tuple[str, ...] = ("mean", "std", "min", "max", "median", "q25", "q75")) -> list[Column]:
    """Aggregate expressions for ``stats``; exact quantiles are left out (see ``numeric_stats``)."""
    makers = {
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
        "skew": lambda c: sample_skew(c),
        "kurt": lambda c: sample_kurt(c),
    }
    out = []
    for name in cols:
        c = F.col(name).cast("double")
        for s in stats:
            if s in QUANTILE_STATS:
                if approx:
                    out.append(quantile(c, QUANTILE_STATS[s], True).alias(f"{prefix}_{name}_{s}"))
            else:
                out.append(makers[s](c).alias(f"{prefix}_{name}_{s}"))
    return out


def numeric_stats(rows: DataFrame, cols: list[str], prefix: str, approx: bool = False,
                  stats: tuple[str, ...] = ("mean", "std", "min", "max", "median", "q25", "q75"),
                  head: list[Column] = (), counts: DataFrame | None = None) -> DataFrame:
    """Per key: ``head`` aggregates, then ``stats`` of every column in ``cols``.

    Algebraic statistics come from one grouped aggregate; exact quantiles from the
    distributed order-statistic plan of ``quantiles`` joined on the key (one
    row per key on both sides), so no task holds all values of a hot key.  ``counts``: the stored counts of the
    columns' values, if there are any."""
    base = rows.groupBy(KEY).agg(*head, *numeric_stat_exprs(cols, prefix, approx, stats))
    wanted = [s for s in stats if s in QUANTILE_STATS]
    if approx or not wanted or not cols:
        return base
    qs = sorted({QUANTILE_STATS[s] for s in wanted})
    names = {q: s for s, q in QUANTILE_STATS.items()}
    lq = Q.quantiles_long(rows, [KEY], cols, qs) if counts is None else Q.quantiles_of_counts(counts, [KEY], qs)
    qdf = Q.wide(lq, [KEY], cols, qs, lambda c, q: f"{prefix}_{c}_{names[q]}")
    order = [KEY, *[f"{prefix}_{c}_{s}" for c in cols for s in stats]]
    head_names = [n for n in base.columns if n not in order]
    return base.join(qdf, KEY, "left").select(KEY, *head_names, *order[1:])


def event_numeric_stats(df: DataFrame, key: str | None = None, prefix: str = "amplitude",
                        approx: bool = False) -> DataFrame:
    """Row count and mean/std/min/max/median/q25/q75 of every numeric column per key."""
    rows, roles, _ = keyed(df, key)
    return numeric_stats(rows, roles["numeric"], prefix, approx, head=[F.count(F.lit(1)).alias(f"{prefix}_records_count")])


def event_moments(df: DataFrame, key: str | None = None, prefix: str = "amplitude") -> DataFrame:
    """Adjusted skewness and unbiased excess kurtosis of every numeric column per key."""
    rows, roles, _ = keyed(df, key)
    return rows.groupBy(KEY).agg(*numeric_stat_exprs(roles["numeric"], prefix, stats=("skew", "kurt")))


def event_intervals(df: DataFrame, key: str | None = None, prefix: str = "amplitude",
                    tiebreak: list[str] = (), bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Per key and time column with at least two values: span seconds, mean and sample std
    of the gaps between consecutive times (in time order)."""
    keys = keyed(df, key)[0].select(KEY).distinct()
    return _join_all([keys, *_interval_frames(df, key, prefix, tiebreak, bucket_us)])


def _interval_frames(df: DataFrame, key: str | None, prefix: str, tiebreak: list[str], bucket_us: int = DEFAULT_BUCKET_US) -> list[DataFrame]:
    rows, roles, types = keyed(df, key)
    frames = []
    for t in roles["time"]:
        x = rows.select(KEY, epoch_micros(t, types[t]).alias("_us"), *tiebreak)
        m = O.gap_moments(x, KEY, "_us", list(tiebreak), bucket_us)
        k = F.col("gaps").cast("double")
        frames.append(m.select(
            KEY,
            F.when(F.col("n") > 1, (F.col("max_us") - F.col("min_us")).cast("double") / US).alias(f"{prefix}_{t}_span_seconds"),
            F.when(F.col("n") > 1, F.col("gap_mean")).alias(f"{prefix}_{t}_avg_interval"),
            F.when(F.col("n") > 2, F.sqrt(F.col("gap_dev") / (k - 1))).alias(f"{prefix}_{t}_std_interval")))
    return frames


def categorical_stats(df: DataFrame, key: str | None = None, prefix: str = "amplitude",
                      cols: list[str] | None = None) -> DataFrame:
    """Per key and string column: distinct non-NULL count, most common value (ties: smallest)
    and its share of all rows of the key.

    Plan: unpivot -> count per (key, column, value) with map-side combine -> one conditional
    aggregate per key.  A hot key's values spread over tasks by (key, column, value).
    """
    rows, roles, _ = keyed(df, key)
    cols = roles["string"] if cols is None else cols
    if not cols:
        return rows.select(KEY).distinct()
    long = rows.select(KEY, F.explode(F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("val")) for i, c in enumerate(cols)
    ])).alias("kv")).select(KEY, "kv.col", "kv.val")
    return _category_stats(long.groupBy(KEY, "col", "val").agg(F.count(F.lit(1)).alias("cnt")), cols, prefix)


def _category_stats(counts: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    """``categorical_stats`` from counted values (key, col, val, cnt)."""
    aggs = []
    for i, c in enumerate(cols):
        is_c = F.col("col") == i
        top = F.min(F.when(is_c & F.col("val").isNotNull(), F.struct((-F.col("cnt")).alias("n"), F.col("val").alias("v"))))
        total = F.sum(F.when(is_c, F.col("cnt")))
        aggs += [
            F.count(F.when(is_c, F.col("val"))).alias(f"{prefix}_{c}_unique_count"),
            top["v"].alias(f"{prefix}_{c}_most_common"),
            (-top["n"] / total).alias(f"{prefix}_{c}_most_common_ratio"),
        ]
    return counts.groupBy(KEY).agg(*aggs)


def _value_counts(rows: DataFrame, numeric: list[str], strings: list[str]) -> DataFrame:
    """Stored counts of every column's values per key, numbers and texts in one pass: (key, _c, _v, _s, _n); ``_c`` numbers the
    numeric columns, then the string columns.  Missing numbers are left out; missing texts count."""
    none = F.lit(None)
    cells = [F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v"), none.cast("string").alias("_s")) for i, c in enumerate(numeric)]
    cells += [F.struct(F.lit(len(numeric) + i).alias("_c"), none.cast("double").alias("_v"), F.col(c).cast("string").alias("_s")) for i, c in enumerate(strings)]
    long = rows.select(KEY, F.explode(F.array(*cells)).alias("_x")).select(KEY, "_x.*")
    wanted = (F.col("_c") >= len(numeric)) | (F.col("_v").isNotNull() & ~F.isnan("_v"))
    return stored(long.where(wanted).groupBy(KEY, "_c", "_v", "_s").agg(F.count(F.lit(1)).alias("_n")), "value-counts")


def event_features(df: DataFrame, key: str | None = None, prefix: str = "amplitude",
                   approx: bool = False, tiebreak: list[str] = ()) -> DataFrame:
    """The full per-key event table: counts, numeric stats + moments, intervals, categories.

    Four scans: the aggregates, the values' counts (stored; quantiles and categories read them), and per time column the rows per
    hour and the rows themselves."""
    rows, roles, _ = keyed(df, key)
    strings, numbers = roles["string"], [] if approx else roles["numeric"]
    counts = _value_counts(rows, numbers, strings) if numbers or strings else None
    numeric = numeric_stats(rows, roles["numeric"], prefix, approx,
                            stats=("mean", "std", "min", "max", "median", "q25", "q75", "skew", "kurt"),
                            head=[F.count(F.lit(1)).alias(f"{prefix}_records_count")],
                            counts=counts.where(F.col("_c") < len(numbers)).drop("_s") if numbers else None)
    frames = [numeric, *_interval_frames(df, key, prefix, tiebreak)]
    if strings:
        texts = counts.where(F.col("_c") >= len(numbers)).select(KEY, (F.col("_c") - len(numbers)).alias("col"), F.col("_s").alias("val"), F.col("_n").alias("cnt"))
        frames.append(_category_stats(texts, strings, prefix))
    return _join_all(frames)


def _hour_flags(ts: Column):
    h = F.hour(ts)
    night = ((h >= NIGHT_FROM) | (h <= NIGHT_TO)).cast("double")
    business = ((h >= BUSINESS_FROM) & (h <= BUSINESS_TO)).cast("double")
    return h, night, business


def temporal_features(df: DataFrame, key: str | None = None, prefix: str = "temporal") -> DataFrame:
    """Per key and time column: count, span minutes, first and last hour, distinct hours,
    night share and business-hours share.  Distinct hours use a 24-bit mask (fixed-size
    buffer, no distinct expansion)."""
    rows, roles, types = keyed(df, key)
    aggs = []
    for t in roles["time"]:
        ts = F.col(t).cast("timestamp_ntz") if types[t].typeName() == "date" else F.col(t)
        h, night, business = _hour_flags(ts)
        us = epoch_micros(ts)
        p = f"{prefix}_{t}"
        aggs += [
            F.count(ts).alias(f"{p}_count"),
            ((F.max(us) - F.min(us)).cast("double") / (60 * US)).alias(f"{p}_span_minutes"),
            F.hour(F.min(ts)).alias(f"{p}_first_hour"),
            F.hour(F.max(ts)).alias(f"{p}_last_hour"),
            F.bit_count(F.bit_or(F.pow(F.lit(2), h).cast("bigint"))).cast("int").alias(f"{p}_unique_hours"),
            F.avg(F.when(ts.isNotNull(), night)).alias(f"{p}_night_ratio"),
            F.avg(F.when(ts.isNotNull(), business)).alias(f"{p}_business_hours_ratio"),
        ]
    return rows.groupBy(KEY).agg(*aggs)


def first_time_column(df: DataFrame, key: str | None) -> str:
    _, roles, _ = keyed(df, key)
    if not roles["time"]:
        raise ValueError("no time column")
    return roles["time"][0]


def session_features(df: DataFrame, key: str | None = None, ts: str | None = None,
                     gap_minutes: int = SESSION_GAP_MINUTES, tiebreak: list[str] = (),
                     prefix: str = "amplitude", bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Gap sessions (a gap longer than ``gap_minutes`` starts a new one) per key: session count,
    mean / sample std of session length in seconds, night-activity and weekend shares."""
    ts = ts or first_time_column(df, key)
    rows, _, types = keyed(df, key)
    x = rows.select(KEY, F.col(ts).alias("_ts"), epoch_micros(ts, types[ts]).alias("_us"), *tiebreak)
    _, night, _ = _hour_flags(F.col("_ts"))
    weekend = (F.weekday("_ts") >= WEEKEND_FROM).cast("double")
    s = O.session_pieces(x, KEY, "_us", gap_minutes * 60 * US, list(tiebreak),
                         {"_night": night, "_weekend": weekend}, bucket_us)
    length = (F.col("end_us") - F.col("start_us")).cast("double") / US
    return s.groupBy(KEY).agg(
        F.count(F.lit(1)).alias(f"{prefix}_session_count"),
        F.avg(length).alias(f"{prefix}_avg_session_duration"),
        F.stddev_samp(length).alias(f"{prefix}_std_session_duration"),
        (F.sum("_night") / F.sum("n")).alias(f"{prefix}_night_activity_ratio"),
        (F.sum("_weekend") / F.sum("n")).alias(f"{prefix}_weekend_ratio"),
    )


def activity_features(df: DataFrame, key: str | None = None, ts: str | None = None,
                      type_col: str | None = "event_type", prefix: str = "amplitude") -> DataFrame:
    """Per key: event count, distinct event types, active clock-hour slots, events per active
    slot, peak hour of day (ties: earliest) and sample variance of the per-hour-of-day counts."""
    ts = ts or first_time_column(df, key)
    rows, _, _ = keyed(df, key)
    slots = rows.groupBy(KEY, F.date_trunc("hour", F.col(ts)).alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    by_hour = slots.groupBy(KEY, F.hour("_slot").alias("_h")).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_slots"))
    top = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_h").alias("h")))
    hours = by_hour.groupBy(KEY).agg(
        F.sum("_n").alias(f"{prefix}_event_count"),
        F.sum("_slots").alias(f"{prefix}_active_slots"),
        (F.sum("_n") / F.sum("_slots")).alias(f"{prefix}_events_per_hour"),
        top["h"].alias(f"{prefix}_peak_hour"),
        F.var_samp(F.col("_n").cast("double")).alias(f"{prefix}_activity_variance"),
    )
    if type_col is None:
        return hours
    types = rows.where(F.col(type_col).isNotNull()).groupBy(KEY, type_col).agg(F.lit(1).alias("_x")) \
        .groupBy(KEY).agg(F.count(F.lit(1)).alias(f"{prefix}_unique_event_types"))
    return hours.join(types, KEY, "left").select(
        KEY, f"{prefix}_event_count", F.coalesce(F.col(f"{prefix}_unique_event_types"), F.lit(0)).cast("bigint")
        .alias(f"{prefix}_unique_event_types"), f"{prefix}_active_slots", f"{prefix}_events_per_hour",
        f"{prefix}_peak_hour", f"{prefix}_activity_variance")


def change_counts(df: DataFrame, cols: list[str], key: str | None = None, ts: str | None = None,
                  tiebreak: list[str] = (), prefix: str = "amplitude",
                  bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Per key: how often each column's value differs from the previous event's (time order,
    NULL-safe; the first event counts no change)."""
    ts = ts or first_time_column(df, key)
    rows, _, types = keyed(df, key)
    x = rows.select(KEY, epoch_micros(ts, types[ts]).alias("_us"), *cols, *[t for t in tiebreak if t not in cols])
    out = O.change_counts(x, KEY, "_us", list(cols), list(tiebreak), bucket_us)
    return out.select(KEY, *[F.col(c).alias(f"{prefix}_{c}_changes") for c in cols])
