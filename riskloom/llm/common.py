"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session that names none (tests, bench) gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='riskloom-shared-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, and hides the input's partitioning, so that a
    later join shuffles both sides and adaptive execution can split a hot key."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; the JVM's ``lower`` does the same on pure ASCII, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks a held-out row (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def free(name: str, taken) -> str:
    """``name``, made longer until no taken name is equal to it, in any case of letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """The columns under names none of which is in ``names``, and what selects them under their own again."""
    low = {n.lower() for n in names}
    moved = [free(c + "_", [*df.columns, *names]) if c.lower() in low else c for c in df.columns]
    return df.toDF(*moved), [F.col(f"`{m}`").alias(c) for m, c in zip(moved, df.columns, strict=True)]


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds ``out`` = sum of column ``c`` up to and including the row, per {out: c}, without all rows in one task.

    The rows are range-sorted and written, so that a repeated task sees the same ranges; a row per range gives what stands before
    it, and the sum goes on inside each range.  Pass rows that differ in ``order``: equal ones share a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("_range").agg(*[F.sum(c).alias(out) for out, c in sums.items()]).orderBy("_range").collect()
    before, offsets = dict.fromkeys(sums, 0), []
    for r in totals:
        offsets.append((r["_range"], *before.values()))
        before = {out: before[out] + (r[out] or 0) for out in sums}
    table = df.sparkSession.createDataFrame(offsets, "_range int, " + ", ".join(f"`_o_{out}` long" for out in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # as many rows as ranges
    return rows.join(F.broadcast(table), "_range").select(*df.columns, *[(F.col(f"_o_{out}") + F.sum(c).over(inside)).alias(out) for out, c in sums.items()])
