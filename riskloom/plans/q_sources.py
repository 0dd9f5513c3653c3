"""File-source queries: link CSV files (written by the query from the derived link rows in
UTF-8 and cp1251, then read back), folder listings and source checks of the driver folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators.ml import shared_dir
from riskloom.plans import fixtures as X
from riskloom.plans import q_quality, q_scores  # noqa: F401  their SQL is that of the sinks
from riskloom.plans.catalog import ORACLE, QUERIES, register, table
from riskloom.sources import files as FS
from riskloom.sources import sinks
from riskloom.sources.tables import audit_chunks

@register("scan_link_csv", r"""
WITH b AS (""" + X.LINK_BASE_SQL + "), link AS (" + X.LINK_SQL + r""")
SELECT "Файлы", "APPLICATIONID", "Абонент 2 прив2", "Дата и время звонка" FROM link""")
def q_scan_link_csv(spark, sf):
    """The derived link rows, written as UTF-8 and as cp1251 files, then read back."""
    base = shared_dir(spark, f"link-csv/{uuid.uuid4().hex}")
    link = X.link_rows(table(spark, sf, "events"))
    even = (F.col("link_row") % 4) < 2
    options = {"header": True, "escape": '"'}
    link.where(even).drop("link_row").write.options(**options).csv(f"{base}/utf8")
    cp1251 = [F.translate(f"`{c}`", FS.CP1251_UPPER, FS.LATIN1_UPPER).alias(c.translate(str.maketrans(FS.CP1251_UPPER, FS.LATIN1_UPPER)))
              for c in link.columns if c != "link_row"]
    link.where(~even).select(*cp1251).write.options(**options).option("encoding", "ISO-8859-1").csv(f"{base}/cp1251")
    read = FS.read_link_csv(spark, f"{base}/*")
    return read.select(*[F.col(f"`{c}`") for c in link.columns if c != "link_row"])


@register("list_call_files", X.with_ctes("""
SELECT path, file_name, file_size FROM calls""", link=False))
def q_list_call_files(spark, sf):
    """The call folder's recordings out of a storage inventory that also lists a sub-folder and other files."""
    inventory = X.call_listing(table(spark, sf, "events")).select("path", "file_size")
    deeper = inventory.select(F.concat(F.lit(X.CALL_DIR + "old/"), F.substring_index("path", "/", -1)).alias("path"), "file_size")
    other = inventory.select(F.concat("path", F.lit(".txt")).alias("path"), "file_size")
    return FS.call_files(inventory.unionByName(deeper).unionByName(other), X.CALL_DIR)


def _data_folder(spark, sf):
    """A data folder with the given tables under the names of the sources they stand for."""
    base = shared_dir(spark, f"data/{uuid.uuid4().hex}")
    events = table(spark, sf, "events")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.parquet(f"{base}/train_amplitude_chunk_{part}.parquet")
    table(spark, sf, "orders").write.parquet(f"{base}/train_app_data.parquet")
    table(spark, sf, "labels").write.parquet(f"{base}/train_target_data.parquet")
    return base


SUMMARY_SQL = """
SELECT * FROM (VALUES (0, 'amplitude_chunks', 3, (SELECT COUNT(*) FROM events), 1, 0),
  (1, 'applications', 1, (SELECT COUNT(*) FROM orders), 1, 0), (2, 'labels', 1, (SELECT COUNT(*) FROM labels), 1, 1),
  (3, 'link_table', 0, NULL, 0, 0), (4, 'audio', 0, NULL, 0, 0)) s(ord, kind, n_sources, n_rows, present, required)"""


@register("source_summary", SUMMARY_SQL)
def q_source_summary(spark, sf):
    return FS.source_summary(spark, _data_folder(spark, sf)).drop("n_files", "bytes")


@register("source_presence", f"""
SELECT kind, required, present, CASE WHEN present = 1 THEN 'ok' WHEN required = 1 THEN 'error' ELSE 'warning' END AS status
FROM ({SUMMARY_SQL})""")
def q_source_presence(spark, sf):
    return FS.source_presence(FS.source_summary(spark, _data_folder(spark, sf)))


@register("audit_chunks", """
SELECT CAST(part AS INTEGER) AS part, COUNT(*) AS expected, COUNT(*) AS read FROM (SELECT event_id % 3 AS part FROM events) GROUP BY part""")
def q_audit_chunks(spark, sf):
    """Footer rows against rows delivered, per chunk."""
    audit = audit_chunks(spark, f"{_data_folder(spark, sf)}/train_amplitude_chunk_*")
    part = F.regexp_extract("path", r"train_amplitude_chunk_(\d)", 1).cast("int").alias("part")
    return audit.groupBy(part).agg(F.sum("expected").alias("expected"), F.sum("read").alias("read"))


@register("predictions_sink", ORACLE["risk_bands"])
def q_predictions_sink(spark, sf):
    """Every scored row written by the predictions sink; half of the rows read back from its CSV, half from its Parquet."""
    base = shared_dir(spark, f"predictions/{uuid.uuid4().hex}")
    rows = QUERIES["risk_bands"](spark, sf)
    sinks.write_predictions(rows, base)
    even = F.col("sample_id") % 2 == 0
    csv = spark.read.schema(rows.schema).option("header", True).csv(f"{base}/csv")
    return csv.where(even).unionByName(spark.read.parquet(f"{base}/parquet").where(~even))


@register("describe_sink", ORACLE["feature_describe"])
def q_describe_sink(spark, sf):
    """The describe table, written as CSV and read back."""
    path = shared_dir(spark, f"describe/{uuid.uuid4().hex}")
    rows = QUERIES["feature_describe"](spark, sf)
    sinks.write_table_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)
