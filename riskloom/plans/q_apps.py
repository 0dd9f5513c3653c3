"""Queries on application-like tables (orders: several rows per key; documents: one row per
key) and on the label table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import apps as A
from riskloom.operators import labels as L
from riskloom.plans.catalog import r6, register, table
from riskloom.sources.tables import read_table

K = "o_custkey"
SPECIAL = r"[^a-zA-Z0-9а-яА-Я \t\n\r\f\v]"

NUMERIC_SQL = f"""
SELECT {K} AS application_id, COUNT(*) AS app_records_count,
  {", ".join(r6(f"{fn}({c})", f"app_{c}_{s}") for c in ("o_orderkey", "o_totalprice")
             for fn, s in (("AVG", "mean"), ("STDDEV_SAMP", "std"), ("MAX", "max"), ("MIN", "min")))}
FROM orders WHERE {K} IS NOT NULL GROUP BY {K}"""

DATE_SQL = f"""
SELECT {K} AS application_id,
  {r6("AVG(floor(epoch_us(o_orderdate) / 1e6))", "app_o_orderdate_timestamp_mean")},
  CAST(MIN(floor(epoch_us(o_orderdate) / 1e6)) AS BIGINT) AS app_o_orderdate_timestamp_min,
  CAST(MAX(floor(epoch_us(o_orderdate) / 1e6)) AS BIGINT) AS app_o_orderdate_timestamp_max,
  {r6("AVG(hour(o_orderdate))", "app_o_orderdate_hour_mean")},
  {r6("AVG(isodow(o_orderdate) - 1)", "app_o_orderdate_day_of_week_mean")},
  {r6("AVG(month(o_orderdate))", "app_o_orderdate_month_mean")}
FROM orders WHERE {K} IS NOT NULL GROUP BY {K}"""

CATEGORY_SQL = f"""
SELECT {K} AS application_id, COUNT(DISTINCT o_orderstatus) AS app_o_orderstatus_unique_count,
  COUNT(DISTINCT o_orderpriority) AS app_o_orderpriority_unique_count
FROM orders WHERE {K} IS NOT NULL GROUP BY {K}"""


@register("scan_applications", "SELECT * FROM orders")
def q_scan_applications(spark, sf):
    return read_table(spark, f"{sf.rstrip('/')}/orders.parquet")


@register("app_numeric_stats", NUMERIC_SQL)
def q_app_numeric_stats(spark, sf):
    return A.app_numeric_stats(table(spark, sf, "orders"), K)


@register("app_date_stats", DATE_SQL)
def q_app_date_stats(spark, sf):
    return A.app_date_stats(table(spark, sf, "orders"), K)


@register("app_category_counts", CATEGORY_SQL)
def q_app_category_counts(spark, sf):
    return A.app_category_counts(table(spark, sf, "orders"), K)


@register("app_features", f"""
SELECT * FROM ({NUMERIC_SQL}) a JOIN ({DATE_SQL}) b USING (application_id) JOIN ({CATEGORY_SQL}) c USING (application_id)""")
def q_app_features(spark, sf):
    return A.app_features(table(spark, sf, "orders"), K)


@register("row_text_features", f"""
SELECT doc_id AS application_id,
  {", ".join(f"CAST(length({c}) AS BIGINT) AS app_{c}_length, "
             f"CAST(length({c}) - length(regexp_replace({c}, '\\p{{Nd}}', '', 'g')) AS BIGINT) AS app_{c}_digit_count, "
             f"CAST(length({c}) - length(regexp_replace({c}, '\\p{{L}}', '', 'g')) AS BIGINT) AS app_{c}_alpha_count, "
             f"CAST(regexp_matches({c}, '{SPECIAL}') AS INTEGER) AS app_{c}_has_special"
             for c in ("text", "lang", "source"))},
  n_chars AS app_n_chars
FROM documents""")
def q_row_text_features(spark, sf):
    return A.row_text_features(table(spark, sf, "documents"), "doc_id")


@register("encode_categories", """
WITH o AS (SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority, o.o_totalprice, c.c_acctbal
           FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
s AS (SELECT o_orderstatus, DENSE_RANK() OVER (ORDER BY o_orderstatus) AS code
      FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL)),
p AS (SELECT o_orderpriority, DENSE_RANK() OVER (ORDER BY o_orderpriority) AS code
      FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL))
SELECT o.o_orderkey, CAST(s.code AS INTEGER) AS app_o_orderstatus_code, CAST(p.code AS INTEGER) AS app_o_orderpriority_code,
  ROUND(CASE WHEN c_acctbal <> 0 THEN o_totalprice / c_acctbal END, 6) AS app_o_totalprice_to_c_acctbal_ratio
FROM o LEFT JOIN s ON o.o_orderstatus = s.o_orderstatus LEFT JOIN p ON o.o_orderpriority = p.o_orderpriority""")
def q_encode_categories(spark, sf):
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey", "left")
    out = A.encode_categories(o, ["o_orderstatus", "o_orderpriority"], ratio=("o_totalprice", "c_acctbal"))
    return out.select("o_orderkey", "app_o_orderstatus_code", "app_o_orderpriority_code",
                      "app_o_totalprice_to_c_acctbal_ratio")


@register("label_distribution", """
SELECT toxic AS label, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share,
       ROUND(SUM(toxic * COUNT(*)) OVER () / SUM(COUNT(*)) OVER (), 6) AS label_mean
FROM labels GROUP BY toxic""")
def q_label_distribution(spark, sf):
    return L.label_distribution(table(spark, sf, "labels"), "toxic")


@register("class_balance", """
WITH c AS (SELECT toxic, COUNT(*) AS n FROM labels GROUP BY toxic)
SELECT COUNT(*) AS n_classes, MIN(n) AS min_count, MAX(n) AS max_count,
  ROUND(MIN(n) / SUM(n), 6) AS minority_share, ROUND(MIN(n) / MAX(n), 6) AS min_max_ratio,
  CAST(COUNT(*) = 2 AND MIN(n) / SUM(n) >= 0.3 AS INTEGER) AS is_balanced FROM c""")
def q_class_balance(spark, sf):
    return L.class_balance(table(spark, sf, "labels"), "toxic")


@register("class_weights", """
WITH c AS (SELECT toxic AS label, COUNT(*) AS n_c FROM labels GROUP BY toxic)
SELECT label, n_c, ROUND(SUM(n_c) OVER () / (COUNT(*) OVER () * n_c), 6) AS weight FROM c""")
def q_class_weights(spark, sf):
    return L.class_weights(table(spark, sf, "labels"), "toxic")
