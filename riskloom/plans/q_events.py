"""Queries on the event table (key ``user_id``, time ``ts``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators import events as ev
from riskloom.operators.ml import shared_dir
from riskloom.plans.catalog import r6, register, table
from riskloom.sources.tables import read_event_chunks, samples

NUM = ["event_id", "value"]
STR = ["event_type", "props"]
TIE = ["event_id"]
P = "amplitude"


def _num_sql(stats=("mean", "std", "min", "max", "median", "q25", "q75")):
    f = {
        "mean": "AVG({c})", "std": "STDDEV_SAMP({c})", "min": "MIN({c})", "max": "MAX({c})",
        "median": "QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5)", "q25": "QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25)",
        "q75": "QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75)",
        "skew": "CASE WHEN COUNT({c}) >= 3 THEN COALESCE(NULLIF(SKEWNESS({c}), 'NaN'::DOUBLE), 0) END",
        "kurt": "CASE WHEN COUNT({c}) >= 4 THEN COALESCE(NULLIF(KURTOSIS({c}), 'NaN'::DOUBLE), 0) END",
    }
    return ", ".join(r6(f[s].format(c=c), f"{P}_{c}_{s}") for c in NUM for s in stats)


NUMERIC_SQL = f"""
SELECT user_id AS application_id, COUNT(*) AS {P}_records_count, {_num_sql()}
FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""

MOMENTS_SQL = f"""
SELECT user_id AS application_id, {_num_sql(("skew", "kurt"))}
FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""

INTERVALS_SQL = f"""
WITH g AS (
  SELECT user_id, epoch_us(ts) AS us,
         epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
  FROM events WHERE user_id IS NOT NULL)
SELECT user_id AS application_id,
  CASE WHEN COUNT(us) > 1 THEN {r6("(MAX(us) - MIN(us)) / 1e6", f"{P}_ts_span_seconds").replace(f" AS {P}_ts_span_seconds", "")} END AS {P}_ts_span_seconds,
  CASE WHEN COUNT(us) > 1 THEN ROUND(AVG(gap / 1e6), 6) END AS {P}_ts_avg_interval,
  CASE WHEN COUNT(us) > 1 THEN ROUND(STDDEV_SAMP(gap / 1e6), 6) END AS {P}_ts_std_interval
FROM g GROUP BY user_id"""


def _cat_sql():
    longs = " UNION ALL ".join(
        f"SELECT user_id, '{c}' AS col, CAST({c} AS VARCHAR) AS val FROM events WHERE user_id IS NOT NULL" for c in STR)
    outs = []
    for c in STR:
        outs += [
            f"MAX(CASE WHEN t.col = '{c}' THEN t.uniq END) AS {P}_{c}_unique_count",
            f"MAX(CASE WHEN t.col = '{c}' THEN r.val END) AS {P}_{c}_most_common",
            f"ROUND(MAX(CASE WHEN t.col = '{c}' THEN r.cnt / t.total END), 6) AS {P}_{c}_most_common_ratio",
        ]
    return f"""
WITH long AS ({longs}),
c AS (SELECT user_id, col, val, COUNT(*) AS cnt FROM long GROUP BY user_id, col, val),
t AS (SELECT user_id, col, SUM(cnt) AS total, COUNT(val) AS uniq FROM c GROUP BY user_id, col),
r AS (SELECT user_id, col, val, cnt,
             ROW_NUMBER() OVER (PARTITION BY user_id, col ORDER BY cnt DESC, val ASC) AS rn
      FROM c WHERE val IS NOT NULL)
SELECT t.user_id AS application_id, {", ".join(outs)}
FROM t LEFT JOIN r ON t.user_id = r.user_id AND t.col = r.col AND r.rn = 1
GROUP BY t.user_id"""


CATEGORICAL_SQL = _cat_sql()

NIGHT = "(hour(ts) >= 22 OR hour(ts) <= 6)"
TEMPORAL_SQL = f"""
SELECT user_id AS application_id,
  COUNT(ts) AS temporal_ts_count,
  ROUND((epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 6e7, 6) AS temporal_ts_span_minutes,
  CAST(hour(MIN(ts)) AS INTEGER) AS temporal_ts_first_hour,
  CAST(hour(MAX(ts)) AS INTEGER) AS temporal_ts_last_hour,
  CAST(COUNT(DISTINCT hour(ts)) AS INTEGER) AS temporal_ts_unique_hours,
  ROUND(AVG(CASE WHEN ts IS NULL THEN NULL WHEN {NIGHT} THEN 1.0 ELSE 0.0 END), 6) AS temporal_ts_night_ratio,
  ROUND(AVG(CASE WHEN ts IS NULL THEN NULL WHEN hour(ts) BETWEEN 9 AND 17 THEN 1.0 ELSE 0.0 END), 6)
    AS temporal_ts_business_hours_ratio
FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""

SESSION_SQL = f"""
WITH g AS (
  SELECT user_id, ts, event_id, epoch_us(ts) AS us,
         epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, SUM(CASE WHEN gap > 1800000000 THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sno FROM g),
p AS (SELECT user_id, sno, (MAX(us) - MIN(us)) / 1e6 AS len, COUNT(*) AS n,
             SUM(CASE WHEN {NIGHT} THEN 1 ELSE 0 END) AS night,
             SUM(CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END) AS wk
      FROM s GROUP BY user_id, sno)
SELECT user_id AS application_id, COUNT(*) AS {P}_session_count,
  ROUND(AVG(len), 6) AS {P}_avg_session_duration, ROUND(STDDEV_SAMP(len), 6) AS {P}_std_session_duration,
  ROUND(SUM(night) / SUM(n), 6) AS {P}_night_activity_ratio, ROUND(SUM(wk) / SUM(n), 6) AS {P}_weekend_ratio
FROM p GROUP BY user_id"""

ACTIVITY_SQL = f"""
WITH sl AS (SELECT user_id, date_trunc('hour', ts) AS slot, COUNT(*) AS n
            FROM events WHERE user_id IS NOT NULL GROUP BY user_id, slot),
h AS (SELECT user_id, hour(slot) AS hr, SUM(n) AS n, COUNT(*) AS slots FROM sl GROUP BY user_id, hr),
r AS (SELECT user_id, hr, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, hr) AS rn FROM h),
ty AS (SELECT user_id, COUNT(DISTINCT event_type) AS ut FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT h.user_id AS application_id, CAST(SUM(h.n) AS BIGINT) AS {P}_event_count,
  CAST(COALESCE(MAX(ty.ut), 0) AS BIGINT) AS {P}_unique_event_types,
  CAST(SUM(h.slots) AS BIGINT) AS {P}_active_slots, ROUND(SUM(h.n) / SUM(h.slots), 6) AS {P}_events_per_hour,
  CAST(MAX(CASE WHEN r.rn = 1 THEN r.hr END) AS INTEGER) AS {P}_peak_hour,
  ROUND(VAR_SAMP(CAST(h.n AS DOUBLE)), 6) AS {P}_activity_variance
FROM h JOIN r ON h.user_id = r.user_id AND h.hr = r.hr LEFT JOIN ty ON h.user_id = ty.user_id
GROUP BY h.user_id"""

CHANGES_SQL = f"""
WITH g AS (
  SELECT user_id, event_type, props, LAG(event_type) OVER w AS pe, LAG(props) OVER w AS pp,
         ROW_NUMBER() OVER w AS rn
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS application_id,
  COUNT(CASE WHEN rn > 1 AND event_type IS DISTINCT FROM pe THEN 1 END) AS {P}_event_type_changes,
  COUNT(CASE WHEN rn > 1 AND props IS DISTINCT FROM pp THEN 1 END) AS {P}_props_changes
FROM g GROUP BY user_id"""

FEATURES_SQL = f"""
SELECT * FROM ({NUMERIC_SQL}) a
JOIN ({MOMENTS_SQL}) b USING (application_id)
JOIN ({INTERVALS_SQL}) c USING (application_id)
JOIN ({CATEGORICAL_SQL}) d USING (application_id)"""


@register("event_numeric_stats", NUMERIC_SQL)
def q_event_numeric_stats(spark, sf):
    return ev.event_numeric_stats(table(spark, sf, "events"))


@register("event_moments", MOMENTS_SQL)
def q_event_moments(spark, sf):
    return ev.event_moments(table(spark, sf, "events"))


@register("event_intervals", INTERVALS_SQL)
def q_event_intervals(spark, sf):
    return ev.event_intervals(table(spark, sf, "events"), tiebreak=TIE)


@register("event_categorical_stats", CATEGORICAL_SQL)
def q_event_categorical_stats(spark, sf):
    return ev.categorical_stats(table(spark, sf, "events"))


@register("event_features", FEATURES_SQL)
def q_event_features(spark, sf):
    return ev.event_features(table(spark, sf, "events"), tiebreak=TIE)


@register("temporal_features", TEMPORAL_SQL)
def q_temporal_features(spark, sf):
    return ev.temporal_features(table(spark, sf, "events"))


@register("session_features", SESSION_SQL)
def q_session_features(spark, sf):
    return ev.session_features(table(spark, sf, "events"), tiebreak=TIE)


@register("activity_features", ACTIVITY_SQL)
def q_activity_features(spark, sf):
    return ev.activity_features(table(spark, sf, "events"))


@register("change_counts", CHANGES_SQL)
def q_change_counts(spark, sf):
    return ev.change_counts(table(spark, sf, "events"), ["event_type", "props"], tiebreak=TIE)


@register("scan_chunks", """
SELECT * EXCLUDE (props), CASE WHEN event_id % 3 <> 2 THEN props END AS props FROM events""")
def q_scan_chunks(spark, sf):
    """The event table written as three chunks, one of them without ``props``, and read as their union."""
    base = shared_dir(spark, f"chunks/{uuid.uuid4().hex}")
    events = table(spark, sf, "events")
    for part in range(3):
        rows = events.where(F.col("event_id") % 3 == part)
        (rows.drop("props") if part == 2 else rows).write.parquet(f"{base}/train_amplitude_chunk_{part}")
    return read_event_chunks(spark, f"{base}/train_amplitude_chunk_*").select(*events.columns)


SAMPLES = {"events": ["user_id", "event_id", "event_type"], "applications": ["o_custkey", "o_orderkey", "o_orderstatus"], "labels": ["doc_id", "quality", "toxic"]}
TABLES = {"events": "events", "applications": "orders", "labels": "labels"}


def _sample_sql(source: str) -> str:
    cols, order = SAMPLES[source], ", ".join(SAMPLES[source][:2])
    fields = ", ".join(f"{c} := {c}" for c in cols)
    return (f"SELECT '{source}' AS source, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS sample_no, CAST(to_json(struct_pack({fields})) AS VARCHAR) AS sample "
            f"FROM {TABLES[source]} QUALIFY row_number() OVER (ORDER BY {order}) <= 10")


@register("source_samples", " UNION ALL ".join(f"({_sample_sql(s)})" for s in SAMPLES))
def q_source_samples(spark, sf):
    return samples({s: (table(spark, sf, TABLES[s]).select(*cols), cols[:2]) for s, cols in SAMPLES.items()})
