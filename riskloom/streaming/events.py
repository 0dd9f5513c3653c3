"""Per-key event features kept current while event chunk files arrive.

The aggregates are the batch operators' own expressions (``events.temporal_features`` and the
algebraic part of ``events.event_numeric_stats``), so a stream over all chunks ends at the same
table as the batch run.  State is one aggregation buffer per key, partitioned by key over the
state store; the checkpoint lives in the cluster's shared checkpoint folder.  Exact quantiles,
gaps and sessions need ordered or multi-pass plans and stay batch-only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators import events as EV
from riskloom.session import checkpoint_dir

ALGEBRAIC = ("mean", "std", "min", "max", "skew", "kurt")


def read_chunk_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """Arriving Parquet chunk files of ``path`` as a stream (schema fixed up front)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("ignoreCorruptFiles", "true").parquet(path))


def streaming_temporal_features(events: DataFrame, key: str | None = None, prefix: str = "temporal") -> DataFrame:
    """Per-key temporal profile (A8) of a streaming frame: every aggregate is incremental."""
    return EV.temporal_features(events, key, prefix)


def streaming_numeric_stats(events: DataFrame, key: str | None = None, prefix: str = "amplitude") -> DataFrame:
    """Per-key row count and algebraic statistics (A2 without quantiles) of a streaming frame."""
    rows, roles, _ = EV.keyed(events, key)
    return rows.groupBy(EV.KEY).agg(F.count(F.lit(1)).alias(f"{prefix}_records_count"),
                                    *EV.numeric_stat_exprs(roles["numeric"], prefix, stats=ALGEBRAIC))


def start_feature_stream(features: DataFrame, sink, name: str | None = None,
                         checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Run a feature aggregation in update mode; every micro-batch of changed keys goes to
    ``sink(batch_df, batch_id)`` (for example a MERGE into a feature table)."""
    spark = features.sparkSession
    if checkpoint is None:
        base = checkpoint_dir(spark)
        if base is None:
            raise ValueError("no checkpoint folder: set spark.checkpoint.dir or pass checkpoint=")
        checkpoint = f"{base.rstrip('/')}/streams/{name or uuid.uuid4().hex}"
    w = features.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    if name:
        w = w.queryName(name)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
