"""Tables Spark derives from the driver tables for roles the driver does not ship directly
(call listings, link rows, scores), each with the same derivation in DuckDB SQL.

Derivations cover every input row (no sampling); the residues below only decide which
derived role a row plays, so that matches, duplicates and misses all occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the derivation.
CALL_DIR = "/calls/"
LINK_PREFIXES = ("/rec/", "C:\\rec\\")
KEY_PREFIX = "Д\\286\\"
FILE_COL, APP_COL, PHONE_COL, TIME_COL = "Файлы", "APPLICATIONID", "Абонент 2 прив2", "Дата и время звонка"


def _pad(c, n):
    return F.lpad(F.col(c).cast("string"), n, "0")


def _file_name():
    return F.concat(
        F.date_format("ts", "yyyyMMddHHmmss"), F.lit("_"), F.col("user_id").cast("string"),
        F.lit("_7700"), _pad("event_id", 7), F.lit(",_"),
        (F.lit(500000) + F.col("event_id") % 300).cast("string"), F.lit(",_"),
        (F.lit(500200) + F.length("event_type")).cast("string"), F.lit(".wav"))


def call_listing(events: DataFrame) -> DataFrame:
    """One call file per event: path, name, size (bytes)."""
    name = _file_name()
    return events.select(
        F.concat(F.lit(CALL_DIR), name).alias("path"), name.alias("file_name"),
        (F.lit(44) + F.col("event_id") * 320).alias("file_size"))


def _link_base(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "ts", F.concat(F.lit("7700"), _pad("event_id", 7)).alias("_phone"),
                         _file_name().alias("_name"))


CALLS_SQL = """
SELECT '/calls/' || n AS path, n AS file_name, 44 + event_id * 320 AS file_size FROM (
  SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || '_' || CAST(user_id AS VARCHAR) || '_7700'
         || lpad(CAST(event_id AS VARCHAR), 7, '0') || ',_' || CAST(500000 + event_id % 300 AS VARCHAR)
         || ',_' || CAST(500200 + length(event_type) AS VARCHAR) || '.wav' AS n
  FROM events)"""


def link_rows(events: DataFrame) -> DataFrame:
    """Link table: file rows for 4 of 5 events (two path styles), a later conflicting row for
    1 in 50, and phone-only rows for 1 in 10 (reached only by the phone fallback)."""
    base = _link_base(events)
    prefix = F.when(F.col("event_id") % 2 == 0, F.lit(LINK_PREFIXES[0])).otherwise(F.lit(LINK_PREFIXES[1]))
    app = F.concat(F.lit(KEY_PREFIX), _pad("user_id", 9))
    when_txt = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    files = base.where(F.col("event_id") % 5 != 0).select(
        F.concat(prefix, F.col("_name")).alias(FILE_COL), app.alias(APP_COL), F.col("_phone").alias(PHONE_COL),
        when_txt.alias(TIME_COL), (F.col("event_id") * 2).alias("link_row"))
    dups = base.where(F.col("event_id") % 50 == 1).select(
        F.col("_name").alias(FILE_COL),
        F.concat(F.lit(KEY_PREFIX), F.lpad((F.col("user_id") + 500).cast("string"), 9, "0")).alias(APP_COL),
        F.col("_phone").alias(PHONE_COL), when_txt.alias(TIME_COL), (F.col("event_id") * 2 + 1).alias("link_row"))
    phones = base.where(F.col("event_id") % 10 == 0).select(
        F.lit(None).cast("string").alias(FILE_COL), app.alias(APP_COL), F.col("_phone").alias(PHONE_COL),
        when_txt.alias(TIME_COL), (F.col("event_id") * 2).alias("link_row"))
    return files.unionByName(dups).unionByName(phones)


LINK_SQL = """
SELECT * FROM (
  SELECT CASE WHEN event_id % 2 = 0 THEN '/rec/' ELSE 'C:\\rec\\' END || n AS "Файлы",
         'Д\\286\\' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS "APPLICATIONID", ph AS "Абонент 2 прив2",
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS "Дата и время звонка", event_id * 2 AS link_row
  FROM b WHERE event_id % 5 <> 0
  UNION ALL
  SELECT n, 'Д\\286\\' || lpad(CAST(user_id + 500 AS VARCHAR), 9, '0'), ph,
         strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id * 2 + 1
  FROM b WHERE event_id % 50 = 1
  UNION ALL
  SELECT NULL, 'Д\\286\\' || lpad(CAST(user_id AS VARCHAR), 9, '0'), ph,
         strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id * 2
  FROM b WHERE event_id % 10 = 0)"""

LINK_BASE_SQL = """
SELECT event_id, user_id, ts, '7700' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS ph,
       strftime(ts, '%Y%m%d%H%M%S') || '_' || CAST(user_id AS VARCHAR) || '_7700'
       || lpad(CAST(event_id AS VARCHAR), 7, '0') || ',_' || CAST(500000 + event_id % 300 AS VARCHAR)
       || ',_' || CAST(500200 + length(event_type) AS VARCHAR) || '.wav' AS n
FROM events"""


def with_ctes(body: str, calls: bool = True, link: bool = True) -> str:
    ctes = []
    if calls:
        ctes.append(f"calls AS ({CALLS_SQL})")
    if link:
        ctes.append(f"b AS ({LINK_BASE_SQL})")
        ctes.append(f"link AS ({LINK_SQL})")
    return "WITH " + ",\n".join(ctes) + "\n" + body


def scores(events: DataFrame) -> DataFrame:
    """Scored rows: p = value / 500, key = user_id, row id = event_id."""
    return events.select(F.col("event_id").alias("sample_id"), F.col("user_id").cast("string").alias("application_id"),
                         (F.col("value") / 500).alias("fraud_probability"))


SCORES_SQL = """SELECT event_id AS sample_id, CAST(user_id AS VARCHAR) AS application_id,
  value / 500 AS fraud_probability FROM events"""


def scored_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with known labels: p = least(n_chars / 10000, 1), label = toxic."""
    return documents.join(labels, "doc_id").select(
        "doc_id", F.least(F.col("n_chars") / 10000, F.lit(1.0)).alias("score"), F.col("toxic").alias("label"))


SCORED_LABELS_SQL = """SELECT d.doc_id, least(d.n_chars / 10000, 1.0) AS score, l.toxic AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
