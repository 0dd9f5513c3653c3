"""Quality and cleaning queries on ``lineitem`` (the wide numeric matrix)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import quality as Q
from riskloom.plans.catalog import r6, register, table

LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
      "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
NUMS = LI[:8]
DOUBLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STRS = ["l_returnflag", "l_linestatus"]


def _labelled(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("is_fraud", (F.col("l_returnflag") == "R").cast("int"))


def _profile_sql():
    k = len(LI)
    nulls = " + ".join(f"(COUNT(*) - COUNT({c}))" for c in LI)
    consts = " + ".join(f"CAST(COALESCE(MIN({c}) = MAX({c}), TRUE) AS INTEGER)" for c in LI)
    high = " + ".join(f"CAST((COUNT(*) - COUNT({c})) > COUNT(*) * 0.5 AS INTEGER)" for c in LI)
    infs = " + ".join(f"COUNT(CASE WHEN isinf({c}) OR isnan({c}) THEN 1 END)" for c in DOUBLES)
    return f"""
SELECT COUNT(*) AS n_rows, CAST({k} AS BIGINT) AS n_columns, CAST({len(NUMS)} AS BIGINT) AS numeric_columns,
  CAST({len(STRS)} AS BIGINT) AS category_columns, CAST({nulls} AS BIGINT) AS null_cells,
  ROUND(({nulls}) / (COUNT(*) * {k}.0), 6) AS missing_ratio, CAST({infs} AS BIGINT) AS inf_cells,
  CAST({consts} AS BIGINT) AS constant_columns, CAST({high} AS BIGINT) AS high_null_columns,
  COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS positive_count,
  COUNT(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS negative_count,
  ROUND(AVG(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS fraud_rate,
  ROUND(CASE WHEN COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) > 0 AND COUNT(CASE WHEN l_returnflag <> 'R' THEN 1 END) > 0
       THEN least(COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END), COUNT(CASE WHEN l_returnflag <> 'R' THEN 1 END)) / COUNT(*) END, 6)
    AS minority_share
FROM lineitem"""


PROFILE_SQL = _profile_sql()


@register("quality_profile", PROFILE_SQL)
def q_quality_profile(spark, sf):
    return Q.quality_profile(_labelled(spark, sf), "is_fraud")


@register("quality_warnings", f"""
WITH p AS ({PROFILE_SQL})
SELECT * FROM (
  SELECT 'fraud_rate_below_1pct' AS rule, fraud_rate AS value, CAST(0.01 AS DOUBLE) AS threshold, CAST(COALESCE(fraud_rate < 0.01, FALSE) AS INTEGER) AS fired FROM p
  UNION ALL SELECT 'fraud_rate_below_5pct', fraud_rate, CAST(0.05 AS DOUBLE), CAST(COALESCE(fraud_rate < 0.05, FALSE) AS INTEGER) FROM p
  UNION ALL SELECT 'fraud_rate_above_50pct', fraud_rate, CAST(0.5 AS DOUBLE), CAST(COALESCE(fraud_rate > 0.5, FALSE) AS INTEGER) FROM p
  UNION ALL SELECT 'missing_above_20pct', missing_ratio, CAST(0.2 AS DOUBLE), CAST(COALESCE(missing_ratio > 0.2, FALSE) AS INTEGER) FROM p
  UNION ALL SELECT 'missing_above_30pct', missing_ratio, CAST(0.3 AS DOUBLE), CAST(COALESCE(missing_ratio > 0.3, FALSE) AS INTEGER) FROM p
  UNION ALL SELECT 'class_balance_below_10pct', minority_share, CAST(0.1 AS DOUBLE), CAST(COALESCE(minority_share < 0.1, FALSE) AS INTEGER) FROM p)""")
def q_quality_warnings(spark, sf):
    return Q.quality_warnings(Q.quality_profile(_labelled(spark, sf), "is_fraud"))


def _colprof_sql():
    parts = []
    for c in LI:
        kind = "numeric" if c in NUMS else "string" if c in STRS else "time"
        like = ("1" if kind == "numeric" else
                f"CAST(COUNT({c}) > 0 AND COUNT(CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL THEN 1 END) = 0 AS INTEGER)"
                if kind == "string" else "0")
        parts.append(f"SELECT '{c}' AS column_name, '{kind}' AS kind, COUNT({c}) AS non_null, "
                     f"CAST(COALESCE(MIN({c}) = MAX({c}), TRUE) AS INTEGER) AS is_constant, "
                     f"CAST({like} AS INTEGER) AS is_numeric_like FROM lineitem")
    return " UNION ALL ".join(parts)


COLPROF_SQL = _colprof_sql()


@register("numeric_columns", f"SELECT column_name, kind, is_numeric_like FROM ({COLPROF_SQL})")
def q_numeric_columns(spark, sf):
    return Q.column_profile(table(spark, sf, "lineitem")).select("column_name", "kind", "is_numeric_like")


@register("constant_columns", f"SELECT column_name, non_null, is_constant FROM ({COLPROF_SQL})")
def q_constant_columns(spark, sf):
    return Q.column_profile(table(spark, sf, "lineitem")).select("column_name", "non_null", "is_constant")


@register("feature_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS count, {r6(f'AVG({c})', 'mean')}, {r6(f'STDDEV_SAMP({c})', 'std')}, "
    f"{r6(f'MIN({c})', 'min')}, {r6(f'QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25)', 'q25')}, "
    f"{r6(f'QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5)', 'median')}, {r6(f'QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75)', 'q75')}, "
    f"{r6(f'MAX({c})', 'max')} FROM lineitem" for c in NUMS))
def q_feature_describe(spark, sf):
    return Q.describe(table(spark, sf, "lineitem"))


@register("datetime_to_epoch", """
SELECT event_id, user_id, event_type, value, props, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS ts_timestamp FROM events""")
def q_datetime_to_epoch(spark, sf):
    return Q.datetime_to_epoch(table(spark, sf, "events"))


@register("coerce_types", f"""
SELECT {", ".join(NUMS)}, {", ".join(f"COALESCE(TRY_CAST({c} AS DOUBLE), 0.0) AS {c}" for c in STRS)},
  CAST(floor(epoch_us(l_shipdate) / 1e6) AS BIGINT) AS l_shipdate FROM lineitem""")
def q_coerce_types(spark, sf):
    return Q.coerce_types(table(spark, sf, "lineitem"))


def _with_inf(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", F.when(
        F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") / F.col("l_discount"))
        .alias("price_per_discount"), F.when(F.col("l_tax") == 0, F.lit(None).cast("double"))
        .otherwise(F.col("l_tax")).alias("l_tax"))


@register("clean_numeric", """
SELECT l_orderkey, l_linenumber, l_quantity,
  ROUND(CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice / l_discount END, 6) AS price_per_discount,
  CASE WHEN l_tax = 0 THEN 0.0 ELSE l_tax END AS l_tax FROM lineitem""")
def q_clean_numeric(spark, sf):
    return Q.clean_numeric(_with_inf(spark, sf), keep=("l_orderkey", "l_linenumber"))


def _for_cleaning(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("l_const", F.lit(5)).withColumn("l_quantity_text", F.col("l_quantity").cast("string")) \
        .withColumn("l_sparse", F.when(F.col("l_linenumber") == 1, F.lit(5)))


@register("clean_features", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  CAST(floor(epoch_us(l_shipdate) / 1e6) AS BIGINT) AS l_shipdate_timestamp,
  TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) AS l_quantity_text,
  CASE WHEN l_linenumber = 1 THEN 5 ELSE 0 END AS l_sparse
FROM lineitem""")
def q_clean_features(spark, sf):
    out, _ = Q.clean_features(_for_cleaning(spark, sf), keep=("l_orderkey", "l_linenumber"))
    return out


@register("impute_median", """
WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS d,
                  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS qn FROM lineitem)
SELECT l_orderkey, l_linenumber,
  ROUND(COALESCE(d, (SELECT QUANTILE_CONT(d, 0.5) FROM x)), 6) AS l_discount,
  ROUND(COALESCE(qn, (SELECT QUANTILE_CONT(qn, 0.5) FROM x)), 6) AS l_quantity FROM x""")
def q_impute_median(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("l_quantity"))
    return Q.impute_median(li, ["l_discount", "l_quantity"])


@register("standardize", f"""
SELECT l_orderkey, l_linenumber, {", ".join(
    f"ROUND(CASE WHEN STDDEV_POP({c}) OVER () = 0 THEN 0.0 ELSE ({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () END, 6) AS {c}"
    for c in DOUBLES)} FROM lineitem""")
def q_standardize(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *DOUBLES)
    return Q.standardize(li, DOUBLES)


@register("align_features", """
SELECT l_orderkey, l_linenumber, CAST(l_tax AS DOUBLE) AS l_tax, 0.0 AS audio_duration,
       CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_linenumber AS DOUBLE) AS l_linenumber_feature
FROM lineitem""")
def q_align_features(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_linenumber_feature", F.col("l_linenumber"))
    return Q.align_features(li, ["l_tax", "audio_duration", "l_quantity", "l_linenumber_feature"],
                            keep=("l_orderkey", "l_linenumber"))


@register("training_gates", """
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT l.toxic) AS n_labels, COUNT(l.toxic) AS labelled_rows,
  CAST(COUNT(*) >= 100 AS INTEGER) AS enough_rows, CAST(COUNT(DISTINCT l.toxic) >= 2 AS INTEGER) AS two_classes,
  CAST(COUNT(l.toxic) = COUNT(*) AS INTEGER) AS aligned
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_training_gates(spark, sf):
    return Q.training_gates(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id"), "toxic")
