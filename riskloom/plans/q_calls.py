"""Queries on call listings and link rows derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import calls as C
from riskloom.operators import keys as K
from riskloom.plans import fixtures as X
from riskloom.plans.catalog import register, table
from riskloom.session import stored

BLANK = r"[ \t\n\r\f\v]"

PARSED_SQL = rf"""
parsed AS (
  SELECT path, file_name, file_size, stem, parts, len(parts) AS np,
         string_split(array_to_string(parts[3:], '_'), ',') AS pieces
  FROM (SELECT *, string_split(stem, '_') AS parts
        FROM (SELECT *, replace(replace(file_name, '.wav', ''), '.mp3', '') AS stem FROM calls))),
pc AS (
  SELECT path, file_name, file_size,
    CASE WHEN np >= 3 THEN parts[2] ELSE stem END AS call_id,
    CASE WHEN np >= 3 AND regexp_matches(parts[1], '^[0-9]{{14}}$')
         THEN try_strptime(parts[1], '%Y%m%d%H%M%S') END AS call_time,
    CASE WHEN np >= 3 THEN pieces[1] END AS phone,
    CASE WHEN np >= 3 THEN list_filter(list_transform(pieces[2:],
         lambda x: regexp_replace(regexp_replace(x, '^_+|_+$', '', 'g'), '^{BLANK}+|{BLANK}+$', '', 'g')),
         lambda x: x <> '') ELSE [] END AS codes,
    parts[1] AS file_user
  FROM parsed)"""

FILE_MAP_SQL = r"""
fm AS (SELECT regexp_extract("Файлы", '([^/\\]*)$', 1) AS file_name, arg_max("APPLICATIONID", link_row) AS app
       FROM link WHERE "Файлы" IS NOT NULL AND "APPLICATIONID" IS NOT NULL GROUP BY 1),
pm AS (SELECT "Абонент 2 прив2" AS phone, arg_max("APPLICATIONID", link_row) AS papp
       FROM link WHERE "Абонент 2 прив2" IS NOT NULL AND "APPLICATIONID" IS NOT NULL GROUP BY 1)"""


def _sql(body: str, link: bool = True) -> str:
    ctes = [f"calls AS ({X.CALLS_SQL})"]
    if link:
        ctes += [f"b AS ({X.LINK_BASE_SQL})", f"link AS ({X.LINK_SQL})"]
    ctes.append(PARSED_SQL.strip())
    if link:
        ctes.append(FILE_MAP_SQL.strip())
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _calls(spark, sf):
    return C.parse_calls(X.call_listing(table(spark, sf, "events")))


def _link(spark, sf):
    return X.link_rows(table(spark, sf, "events"))


@register("parse_call_names", _sql("""
SELECT file_name, call_id, call_time, phone, array_to_string(codes, ',') AS codes_text,
       CAST(len(codes) AS INTEGER) AS codes_count, file_user FROM pc""", link=False))
def q_parse_call_names(spark, sf):
    c = _calls(spark, sf)
    return c.select("file_name", "call_id", "call_time", "phone", F.array_join("codes", ",").alias("codes_text"),
                    F.size("codes").alias("codes_count"), "file_user")


@register("call_features", _sql("""
SELECT pc.file_name, COALESCE(fm.app, pc.call_id) AS application_id,
  CAST(hour(call_time) AS INTEGER) AS audio_call_hour, CAST(isodow(call_time) - 1 AS INTEGER) AS audio_call_weekday,
  CAST(isodow(call_time) - 1 >= 5 AS INTEGER) AS audio_call_is_weekend,
  CAST(hour(call_time) >= 22 OR hour(call_time) <= 6 AS INTEGER) AS audio_call_is_night,
  CAST(hour(call_time) BETWEEN 9 AND 17 AS INTEGER) AS audio_call_is_business_hours,
  CAST(length(phone) AS INTEGER) AS audio_phone_length,
  CAST(starts_with(phone, '7') AS INTEGER) AS audio_phone_starts_with_7,
  CAST(starts_with(phone, '8') AS INTEGER) AS audio_phone_starts_with_8,
  CAST(length(phone) > 10 AS INTEGER) AS audio_phone_has_country_code,
  CAST(len(codes) AS INTEGER) AS audio_codes_count, CAST(len(codes) > 0 AS INTEGER) AS audio_has_codes,
  codes[1] AS audio_code_1, codes[2] AS audio_code_2, codes[3] AS audio_code_3,
  file_size AS audio_file_size_bytes, ROUND(file_size / 1048576, 6) AS audio_file_size_mb,
  ROUND(file_size / 32000, 6) AS audio_estimated_duration
FROM pc LEFT JOIN fm ON pc.file_name = fm.file_name"""))
def q_call_features(spark, sf):
    return C.call_features(C.link_calls(_calls(spark, sf), _link(spark, sf)), app_col=C.KEY)


@register("call_profile", _sql("""
SELECT COUNT(*) AS n_files, COUNT(DISTINCT call_id) AS n_call_ids, CAST(SUM(file_size) AS BIGINT) AS total_bytes,
       ROUND(AVG(CASE WHEN call_time IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS time_parsed_share FROM pc""", link=False))
def q_call_profile(spark, sf):
    return C.call_profile(_calls(spark, sf))


@register("link_calls", _sql("""
SELECT pc.file_name, pc.call_id, pc.phone, fm.app AS application_id
FROM pc LEFT JOIN fm ON pc.file_name = fm.file_name"""))
def q_link_calls(spark, sf):
    return C.link_calls(_calls(spark, sf), _link(spark, sf)).select("file_name", "call_id", "phone", C.KEY)


@register("link_calls_fallback", _sql("""
SELECT pc.file_name, pc.call_id, pc.phone, COALESCE(fm.app, pm.papp) AS application_id,
  CASE WHEN fm.app IS NOT NULL THEN 'file' WHEN pm.papp IS NOT NULL THEN 'phone' END AS link_method
FROM pc LEFT JOIN fm ON pc.file_name = fm.file_name LEFT JOIN pm ON pc.phone = pm.phone"""))
def q_link_calls_fallback(spark, sf):
    return C.link_calls_fallback(_calls(spark, sf), _link(spark, sf), X.PHONE_COL).select(
        "file_name", "call_id", "phone", C.KEY, "link_method")


@register("link_coverage", _sql("""
SELECT COUNT(*) AS total_calls, COUNT(fm.app) AS linked_calls,
  ROUND(AVG(CASE WHEN fm.app IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS link_rate,
  CASE WHEN AVG(CASE WHEN fm.app IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.9 THEN 'excellent'
       WHEN AVG(CASE WHEN fm.app IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.7 THEN 'acceptable'
       ELSE 'critical' END AS link_grade
FROM pc LEFT JOIN fm ON pc.file_name = fm.file_name"""))
def q_link_coverage(spark, sf):
    return C.link_coverage(C.link_calls(_calls(spark, sf), _link(spark, sf)))


@register("data_coverage", _sql("""
SELECT COUNT(*) AS total_records, COUNT(k) AS with_id, ROUND(COUNT(k) / COUNT(*), 6) AS id_coverage,
  COUNT(file_name) AS with_recording, ROUND(COUNT(file_name) / COUNT(*), 6) AS recording_coverage,
  COUNT(toxic) AS with_label, ROUND(COUNT(toxic) / COUNT(*), 6) AS label_coverage,
  COUNT(CASE WHEN k IS NULL AND file_name IS NOT NULL THEN 1 END) AS orphan_recordings
FROM (SELECT pc.file_name, fm.app AS k FROM pc LEFT JOIN fm ON pc.file_name = fm.file_name) c
LEFT JOIN labels l ON c.k = 'Д\\286\\' || lpad(CAST(l.doc_id AS VARCHAR), 9, '0')"""))
def q_data_coverage(spark, sf):
    key = F.concat(F.lit(X.KEY_PREFIX), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    labels = table(spark, sf, "labels").select(key.alias(C.KEY), F.col("toxic").alias("label"))
    return C.data_coverage(C.link_calls(_calls(spark, sf), _link(spark, sf)).join(labels, C.KEY, "left"))


@register("latest_per_key", _sql("""
SELECT application_id, arg_max(file_name, (call_time, file_name)) AS file_name, MAX(call_time) AS call_time,
       arg_max(call_id, (call_time, file_name)) AS call_id, arg_max(phone, (call_time, file_name)) AS phone,
       arg_max(file_size, (call_time, file_name)) AS file_size, COUNT(*) AS n_calls, COUNT(*) - 1 AS n_superseded
FROM (SELECT pc.*, COALESCE(fm.app, pm.papp) AS application_id
      FROM pc LEFT JOIN fm ON pc.file_name = fm.file_name LEFT JOIN pm ON pc.phone = pm.phone)
WHERE application_id IS NOT NULL GROUP BY application_id"""))
def q_latest_per_key(spark, sf):
    latest = C.latest_per_key(C.link_calls_fallback(_calls(spark, sf), _link(spark, sf), X.PHONE_COL))
    return latest.select(C.KEY, "file_name", "call_time", "call_id", "phone", "file_size", "n_calls", "n_superseded")


@register("orphan_calls", _sql("""
SELECT file_name, call_id, phone FROM pc
WHERE file_name NOT IN (SELECT file_name FROM fm) AND phone NOT IN (SELECT phone FROM pm)"""))
def q_orphan_calls(spark, sf):
    return C.orphan_calls(_calls(spark, sf), _link(spark, sf), X.PHONE_COL).select("file_name", "call_id", "phone")


@register("normalize_keys", r"""
WITH b AS (""" + X.LINK_BASE_SQL + "), link AS (" + X.LINK_SQL + r""")
SELECT link_row, "APPLICATIONID" AS raw_key,
  NULLIF(upper(replace(regexp_replace("APPLICATIONID", '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '\\', '\')), '')
    AS key
FROM link""")
def q_normalize_keys(spark, sf):
    link = _link(spark, sf)
    return K.normalize_keys(link, X.APP_COL).select("link_row", F.col(X.APP_COL).alias("raw_key"), "key")


@register("key_overlap", """
WITH u AS (SELECT CAST(user_id AS VARCHAR) AS key, 1 AS tag FROM events WHERE user_id IS NOT NULL
           UNION ALL SELECT CAST(o_custkey AS VARCHAR), 2 FROM orders WHERE o_custkey IS NOT NULL
           UNION ALL SELECT CAST(c_custkey AS VARCHAR), 4 FROM customer WHERE c_custkey IS NOT NULL),
m AS (SELECT key, bit_or(tag) AS mask FROM u GROUP BY key)
SELECT mask, concat_ws('+', CASE WHEN mask & 1 > 0 THEN 'events' END, CASE WHEN mask & 2 > 0 THEN 'orders' END,
                       CASE WHEN mask & 4 > 0 THEN 'customer' END) AS sources, COUNT(*) AS n_keys
FROM m GROUP BY mask""")
def q_key_overlap(spark, sf):
    return K.key_overlap({"events": (table(spark, sf, "events"), "user_id"),
                          "orders": (table(spark, sf, "orders"), "o_custkey"),
                          "customer": (table(spark, sf, "customer"), "c_custkey")})


# Fixed value: the client-key format of the right side of the fuzzy join.
CLIENT_KEY_PREFIX = "Д286-"


@register("fuzzy_key_join", X.with_ctes(r"""
, cu AS (SELECT c_custkey, c_name, c_mktsegment, 'Д286-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS client_key
         FROM customer),
lk AS (SELECT DISTINCT "APPLICATIONID" AS k FROM link WHERE "APPLICATIONID" IS NOT NULL),
rk AS (SELECT DISTINCT client_key AS k FROM cu),
pairs AS (SELECT lk.k AS a, rk.k AS b, levenshtein(lk.k, rk.k) AS ed, greatest(length(lk.k), length(rk.k)) AS m
          FROM lk, rk),
best AS (SELECT a, b, ed, m FROM (
           SELECT *, row_number() OVER (PARTITION BY a ORDER BY ed, m DESC, b) AS rn FROM pairs WHERE ed * 5 <= m)
         WHERE rn = 1)
SELECT link."Файлы", link."APPLICATIONID", link."Абонент 2 прив2", link."Дата и время звонка", link.link_row,
       ROUND(1 - best.ed / best.m, 6) AS key_similarity, cu.c_custkey, cu.c_name, cu.c_mktsegment, cu.client_key
FROM link JOIN best ON link."APPLICATIONID" = best.a JOIN cu ON cu.client_key = best.b""", calls=False).replace(
    "\n, cu AS", ",\ncu AS"))
def q_fuzzy_key_join(spark, sf):
    cu = table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_mktsegment",
        F.concat(F.lit(CLIENT_KEY_PREFIX), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("client_key"))
    return K.fuzzy_key_join(_link(spark, sf), cu, X.APP_COL, "client_key", 0.8)


@register("fuzzy_key_join_blocks")
def q_fuzzy_key_join_blocks(spark, sf):
    """The same join by the share of characters in matching blocks."""
    cu = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.concat(F.lit(CLIENT_KEY_PREFIX), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("client_key"))
    return K.fuzzy_key_join(_link(spark, sf), cu, X.APP_COL, "client_key", 0.8, measure="blocks").select(
        "link_row", X.APP_COL, "c_custkey", "client_key", "key_similarity")


@register("time_agreement", _sql(r"""
SELECT COUNT(*) AS linked_calls, COUNT(d) AS with_times, COUNT(CASE WHEN d <= 60 THEN 1 END) AS agreeing, ROUND(MAX(d), 6) AS largest_difference,
  ROUND(COUNT(CASE WHEN d <= 60 THEN 1 END) / COUNT(d), 6) AS time_agreement,
  CASE WHEN COUNT(CASE WHEN d <= 60 THEN 1 END) / COUNT(d) > 0.9 THEN 'excellent' WHEN COUNT(CASE WHEN d <= 60 THEN 1 END) / COUNT(d) >= 0.7 THEN 'acceptable'
       ELSE 'critical' END AS time_grade
FROM (SELECT abs(epoch_us(pc.call_time) - epoch_us(t.at)) / 1e6 AS d FROM pc JOIN (
  SELECT regexp_extract("Файлы", '([^/\\]*)$', 1) AS file_name,
         arg_max(CAST("Дата и время звонка" AS TIMESTAMP) + CASE WHEN link_row % 16 = 2 THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END, link_row) AS at
  FROM link WHERE "Файлы" IS NOT NULL AND "APPLICATIONID" IS NOT NULL GROUP BY 1) t ON pc.file_name = t.file_name)"""))
def q_time_agreement(spark, sf):
    """Agreement of the calls' times with the link table's, every eighth row of which is five minutes late."""
    late = F.when(F.col("link_row") % 16 == 2, F.expr("INTERVAL 5 MINUTES")).otherwise(F.expr("INTERVAL 0 MINUTES"))
    link = _link(spark, sf).withColumn(X.TIME_COL, (F.col(X.TIME_COL).cast("timestamp_ntz") + late).cast("string"))
    return C.time_agreement(C.link_calls(_calls(spark, sf), link, time_col=X.TIME_COL))


@register("call_sketches", _sql("""
SELECT CAST(call_time AS DATE) AS day, COUNT(*) AS n_files, COUNT(DISTINCT call_id) AS n_call_ids, 1 AS estimate_within_bound FROM pc GROUP BY 1""", link=False))
def q_call_sketches(spark, sf):
    """Exact distinct ids per day, and whether the merged sketches of the day's call kinds estimate them within four standard errors."""
    calls = _calls(spark, sf)
    parts = stored(C.call_sketches(calls), "call-sketches")
    day = F.to_date("call_time").alias("day")
    exact = calls.groupBy(day).agg(F.count_distinct("call_id").alias("n_call_ids"))
    merged = C.merged_call_counts(parts, "day").withColumnRenamed("n_call_ids", "estimate")
    near = F.abs(F.col("estimate") - F.col("n_call_ids")) <= F.greatest(F.lit(1.0), 4 * C.SKETCH_ERROR * F.col("n_call_ids"))
    return merged.join(exact, "day").select("day", "n_files", "n_call_ids", near.cast("int").alias("estimate_within_bound"))
