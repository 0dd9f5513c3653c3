"""Session construction and lineage helpers.

Library functions never set session configuration; only ``build_session`` (used by
tests, the bench and local runs) does.  On a cluster the caller brings its own session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "riskloom",
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared lineage folder the cluster names in ``spark.checkpoint.dir``.

    A fallback is only applied when the session has none (local tests); on a cluster the
    configured shared folder is always used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if fallback is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            return None
        fallback = tempfile.mkdtemp(prefix="riskloom-ckpt-")  # one machine: driver and executor are one process
    os.makedirs(fallback, exist_ok=True)
    sc.setCheckpointDir(fallback)
    return fallback


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    spark = df.sparkSession
    if checkpoint_dir(spark) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: survives executor loss, and Spark knows its size
    when it plans a join, so it broadcasts the table exactly while that is small."""
    base = checkpoint_dir(df.sparkSession)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
