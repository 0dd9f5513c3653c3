"""Queries joining several sources: events + applications + calls (+ labels), matrices,
time-window join, splits and synthetic labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import apps as A
from riskloom.operators import assemble as M
from riskloom.operators import calls as C
from riskloom.operators import quality as Q
from riskloom.operators import splits as SP
from riskloom.plans import fixtures as X
from riskloom.plans import q_apps, q_calls
from riskloom.plans.catalog import register, table

KEYF = "'Д\\286\\' || lpad(CAST({c} AS VARCHAR), 9, '0')"


def _key(c):
    return F.concat(F.lit(X.KEY_PREFIX), F.lpad(F.col(c).cast("string"), 9, "0"))


def _events(spark, sf):
    return table(spark, sf, "events").withColumn(M.KEY, _key("user_id"))


def _app_features(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_custkey", _key("o_custkey"))
    return A.app_features(o, "o_custkey")


def _call_aggregates(spark, sf):
    calls = C.link_calls(C.parse_calls(X.call_listing(table(spark, sf, "events"))), X.link_rows(table(spark, sf, "events")))
    return C.calls_per_application(C.call_features(calls, app_col=C.KEY))


def _labels(spark, sf):
    return table(spark, sf, "labels").withColumn(M.KEY, _key("doc_id")).drop("doc_id")


def _merged(spark, sf):
    return M.merge_all_left(_events(spark, sf), _app_features(spark, sf), _call_aggregates(spark, sf))


APP_SQL = f"""SELECT {KEYF.format(c="application_id")} AS application_id, * EXCLUDE (application_id)
FROM ({q_apps.NUMERIC_SQL.replace("SELECT", "SELECT", 1)}) a JOIN ({q_apps.DATE_SQL}) b USING (application_id)
JOIN ({q_apps.CATEGORY_SQL}) c USING (application_id)"""

CALL_AGG_SQL = q_calls._sql("""
, cf AS (SELECT COALESCE(fm.app, pc.call_id) AS application_id, file_size / 32000 AS d,
       CAST(hour(call_time) >= 22 OR hour(call_time) <= 6 AS INTEGER) AS night,
       CAST(hour(call_time) BETWEEN 9 AND 17 AS INTEGER) AS business
  FROM pc LEFT JOIN fm ON pc.file_name = fm.file_name)
SELECT application_id, COUNT(*) AS audio_calls_count, AVG(d) AS audio_duration_mean, MAX(d) AS audio_duration_max,
       AVG(night) AS audio_night_call_ratio, AVG(business) AS audio_business_call_ratio FROM cf GROUP BY application_id""")

APP_COLS = (["app_records_count"] + [f"app_{c}_{s}" for c in ("o_orderkey", "o_totalprice") for s in ("mean", "std", "max", "min")]
            + [f"app_o_orderdate_{s}" for s in ("timestamp_mean", "timestamp_min", "timestamp_max", "hour_mean",
                                                 "day_of_week_mean", "month_mean")]
            + ["app_o_orderstatus_unique_count", "app_o_orderpriority_unique_count"])
CALL_COLS = ["audio_calls_count", "audio_duration_mean", "audio_duration_max", "audio_night_call_ratio",
             "audio_business_call_ratio"]
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props", "application_id"]


def _merged_sql(select: str, tail: str = "") -> str:
    call_ctes, call_body = CALL_AGG_SQL.split("\n, cf AS", 1)
    return f"""{call_ctes},
cf AS {call_body.split("SELECT application_id, COUNT(*)", 1)[0]},
ca AS (SELECT application_id, COUNT(*) AS audio_calls_count, AVG(d) AS audio_duration_mean, MAX(d) AS audio_duration_max,
       AVG(night) AS audio_night_call_ratio, AVG(business) AS audio_business_call_ratio FROM cf GROUP BY application_id),
ap AS ({APP_SQL}),
ev AS (SELECT *, {KEYF.format(c="user_id")} AS application_id FROM events WHERE user_id IS NOT NULL),
mg AS (SELECT ev.*, {", ".join(f"ap.{c}" for c in APP_COLS)}, {", ".join(f"ca.{c}" for c in CALL_COLS)}
       FROM ev LEFT JOIN ap ON ev.application_id = ap.application_id LEFT JOIN ca ON ev.application_id = ca.application_id)
{tail}
SELECT {select}"""


def _num_cast(c, coalesce=False, table=""):
    e = f"COALESCE({table}{c}, 0)" if coalesce else f"{table}{c}"
    if c in ("app_records_count", "app_o_orderstatus_unique_count", "app_o_orderpriority_unique_count",
             "audio_calls_count", "app_o_orderdate_timestamp_min", "app_o_orderdate_timestamp_max"):
        return f"CAST({e} AS BIGINT) AS {c}"
    return f"ROUND(CAST({e} AS DOUBLE), 6) AS {c}"


MERGED_SELECT = ", ".join(EVENT_COLS + [_num_cast(c) for c in APP_COLS + CALL_COLS]) + " FROM mg"


@register("merge_all_left", _merged_sql(MERGED_SELECT))
def q_merge_all_left(spark, sf):
    return _merged(spark, sf)


LABELLED_SELECT = (", ".join([f"mg.{c}" for c in EVENT_COLS] + [_num_cast(c, table="mg.") for c in APP_COLS + CALL_COLS])
                   + ", l.toxic AS label, l.quality FROM mg JOIN labels l ON mg.application_id = "
                   + KEYF.format(c="l.doc_id"))


@register("merge_with_labels", _merged_sql(LABELLED_SELECT))
def q_merge_with_labels(spark, sf):
    return M.merge_all(_events(spark, sf), _app_features(spark, sf), _call_aggregates(spark, sf), _labels(spark, sf), "toxic")


@register("prediction_base", _merged_sql(
    ", ".join(["event_id", "ts", "user_id", "COALESCE(event_type, 'unknown') AS event_type", "COALESCE(value, 0) AS value",
               "COALESCE(props, 'unknown') AS props", "application_id"]
              + [_num_cast(c, True) for c in APP_COLS + CALL_COLS]) + " FROM mg"))
def q_prediction_base(spark, sf):
    return Q.clean_merged(_merged(spark, sf), keep=("ts",))


@register("clean_merged", _merged_sql(
    ", ".join(["mg.event_id", "mg.ts", "mg.user_id", "COALESCE(mg.event_type, 'unknown') AS event_type",
               "COALESCE(mg.value, 0) AS value", "COALESCE(mg.props, 'unknown') AS props", "mg.application_id"]
              + [_num_cast(c, True, "mg.") for c in APP_COLS + CALL_COLS])
    + ", l.toxic AS label, l.quality FROM mg JOIN labels l ON mg.application_id = " + KEYF.format(c="l.doc_id")))
def q_clean_merged(spark, sf):
    rows = M.merge_all(_events(spark, sf), _app_features(spark, sf), _call_aggregates(spark, sf), _labels(spark, sf), "toxic")
    return Q.clean_merged(rows, keep=("ts",))


# hour_mean is 0 for every date, so the cleaning drops it; a single row has no std, which counts as 0.
MATRIX_COLS = [c for c in APP_COLS if not c.endswith("hour_mean")]
MATRIX_SQL = f"""SELECT application_id, {", ".join(_num_cast(c, True) for c in MATRIX_COLS)} FROM (
SELECT * FROM ({q_apps.NUMERIC_SQL}) a JOIN ({q_apps.DATE_SQL}) b USING (application_id) JOIN ({q_apps.CATEGORY_SQL}) c USING (application_id))"""


def order_matrix(spark, sf):
    """Features of a customer's orders, labelled by the document label of the same number."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "o_custkey")
    return M.training_matrix(table(spark, sf, "orders"), labels, "o_custkey", "toxic")


@register("training_matrix", f"""
SELECT f.*, l.toxic AS label FROM ({MATRIX_SQL}) f JOIN labels l ON f.application_id = l.doc_id""")
def q_training_matrix(spark, sf):
    return order_matrix(spark, sf)[0]


@register("prediction_matrix", MATRIX_SQL)
def q_prediction_matrix(spark, sf):
    return M.prediction_matrix(table(spark, sf, "orders"), "o_custkey")


APP_DATE = "DATE '2024-01-01' + CAST(date_diff('day', DATE '1995-01-01', o_orderdate) % 30 AS INTEGER)"


@register("temporal_join", f"""
WITH a AS (SELECT o_orderkey, o_custkey, CAST({APP_DATE} AS DATE) AS app_date FROM orders),
e AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
c AS (SELECT a.*, e.event_id, e.ts, e.user_id, e.event_type, e.value, e.props,
             ROW_NUMBER() OVER (PARTITION BY a.o_orderkey ORDER BY e.ts, e.event_id) AS rn
      FROM a JOIN e ON e.day BETWEEN a.app_date - 1 AND a.app_date + 1)
SELECT * EXCLUDE (rn) FROM c WHERE rn = 1""")
def q_temporal_join(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey",
        F.date_add(F.lit("2024-01-01").cast("date"),
                   (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) % 30).cast("int")).alias("app_date"))
    return M.temporal_join(o, "o_orderkey", "app_date", table(spark, sf, "events"), "ts", ["ts", "event_id"])


@register("synthetic_labels", """
WITH r AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)
SELECT doc_id, CAST(rn <= (SELECT CAST(floor(COUNT(*) * 0.02) AS BIGINT) FROM documents) AS INTEGER) AS synthetic_label FROM r""")
def q_synthetic_labels(spark, sf):
    return SP.synthetic_labels(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.02)


SCORED = """SELECT d.doc_id, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


@register("stratified_split", f"""
WITH s AS ({SCORED}),
n AS (SELECT label, COUNT(*) AS n FROM s GROUP BY label),
r AS (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.label ORDER BY md5('42:' || CAST(s.doc_id AS VARCHAR)), s.doc_id) AS rn FROM s)
SELECT r.doc_id, r.label, CAST(r.rn <= CAST(floor(n.n * 0.2) AS BIGINT) AS INTEGER) AS is_test
FROM r JOIN n ON r.label = n.label""")
def q_stratified_split(spark, sf):
    s = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("toxic").alias("label"))
    return SP.stratified_split(s, "doc_id", "label", 0.2).select("doc_id", "label", "is_test")


@register("hash_split", """
SELECT doc_id, CAST(substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8) < '33333333' AS INTEGER) AS is_test FROM labels""")
def q_hash_split(spark, sf):
    return SP.hash_split(table(spark, sf, "labels").select("doc_id"), "doc_id", 0.2)


@register("fold_assignment", """
SELECT doc_id, CAST(CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold
FROM labels""")
def q_fold_assignment(spark, sf):
    return SP.fold_id(table(spark, sf, "labels").select("doc_id"), "doc_id", 5)
