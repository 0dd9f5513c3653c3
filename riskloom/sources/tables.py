"""Table readers.  Their results are lazy scans: filters and projections applied later reach
the Parquet scan (PushedFilters / ReadSchema).  The chunk reader first audits its files."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.stats import nan_to_null
from riskloom.session import stored


def _paths(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - Spark wraps the reader's own errors
        if any(c in str(e) for c in ("PERMISSION", "AccessControl", "Permission denied")):
            raise
        return False
    return True


def audit_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row (path, bytes, expected, read) per non-empty chunk file of the glob, stored in the shared folder.

    ``expected`` is the footer's row count, which a scan of no column delivers without touching the data;
    ``read`` counts the rows of a scan that decodes every column and goes on past damaged parts.  Both are partial sums
    per file, so a large file's row groups are counted by several tasks.  A file whose footer cannot be read
    has no ``expected``; only files that give no row at all are looked at one by one for that."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_paths(paths)).where("length > 0").select(
        F.col("_metadata.file_path").alias("_uri"), "path", F.col("length").alias("bytes"))
    rows = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").option("recursiveFileLookup", "true")
    try:
        rows = rows.parquet(*_paths(paths))
    except AnalysisException as e:  # no file has a footer
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return stored(listed.select("path", "bytes", F.lit(None).cast("long").alias("expected"), F.lit(0).cast("long").alias("read")), "chunk-audit")
    uri = F.col("_metadata.file_path").alias("_uri")
    footer = rows.select(uri).groupBy("_uri").agg(F.count(F.lit(1)).alias("expected"))
    # the digest makes the scan decode all columns
    digest = F.xxhash64(*[F.col(f"`{c}`").cast("string") if isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(f"`{c}`") for c in rows.columns])
    decoded = rows.select(uri, digest.alias("_d")).groupBy("_uri").agg(F.count(F.lit(1)).alias("read"), F.bit_xor("_d").alias("digest"))
    found = stored(listed.join(footer, "_uri", "left").join(decoded, "_uri", "left").select(
        "path", "bytes", "expected", F.coalesce("read", F.lit(0)).alias("read"), "digest"), "chunk-audit")
    silent = [r["path"] for r in found.where("expected IS NULL").select("path").collect()]  # empty tables and broken footers only
    empty = [p for p in silent if _readable(spark, p)]
    return found.withColumn("expected", F.when(F.col("path").isin(empty), 0).otherwise(F.col("expected"))).drop("digest")


def unread_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The chunk files that ``read_event_chunks`` rejects: path, bytes, expected rows (NULL: no footer) and rows read."""
    return audit_chunks(spark, paths).where(~F.col("expected").eqNullSafe(F.col("read")))


def read_event_chunks(spark: SparkSession, paths: str | list[str], tag: str = "source_chunk") -> DataFrame:
    """All chunk files of a glob: union by column name (missing columns become NULL), each row tagged with its
    file name.  A file is read whole or not at all: ``audit_chunks`` reads all files once when the frame is built,
    and a file that delivers other than the rows its footer promises is left out (``unread_chunks`` names it).
    No readable file gives an empty frame with the tag alone."""
    audit = audit_chunks(spark, paths)
    whole = [r["path"] for r in audit.where("expected = read").select("path").orderBy("path").collect()]  # a path per file, as the reader needs
    if not whole:
        return spark.createDataFrame([], f"`{tag}` string")
    return spark.read.option("mergeSchema", "true").parquet(*whole).withColumn(tag, F.col("_metadata.file_name"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One Parquet table; a missing path gives an empty frame with ``schema`` when given."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        if schema is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL (one notion of missing, as pandas has)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(nan_to_null(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def samples(sources: dict[str, tuple[DataFrame, list[str]]], n: int = 10) -> DataFrame:
    """The first ``n`` rows of every source in the order of its columns: (source, sample_no, sample), the row as JSON.

    Each source takes its own bounded top rows (no global sort); the numbers are given to those alone."""
    parts = []
    for name, (df, order) in sources.items():
        top = df.orderBy(*[F.col(f"`{c}`") for c in order]).limit(n)
        rows = top.agg(F.sort_array(F.collect_list(F.struct(F.struct(*[F.col(f"`{c}`") for c in order]).alias("by"), F.to_json(F.struct("*")).alias("sample")))).alias("_rows"))
        parts.append(rows.select(F.lit(name).alias("source"), F.posexplode("_rows").alias("_i", "_r")).select("source", (F.col("_i") + 1).alias("sample_no"), "_r.sample"))
    return reduce(DataFrame.unionByName, parts)
