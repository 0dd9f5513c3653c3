"""A stream over event chunk files ends at the batch feature tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import events as EV
from riskloom.streaming import events as SE
from tests.conftest import SF_SMALL


def _snapshot(spark, features, name):
    latest = {}

    def sink(batch, _id):
        for r in batch.collect():  # test sink: a few hundred keys
            latest[r[EV.KEY]] = r.asDict()

    q = SE.start_feature_stream(features, sink, name=name, available_now=True)
    q.awaitTermination(300)
    return latest


def _round(d):
    return {k: (round(v, 9) if isinstance(v, float) else v) for k, v in d.items()}


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="riskloom-stream-src-")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").drop("props")
    ev.withColumn("_part", F.col("event_id") % 3).write.partitionBy("_part").parquet(f"{src}/chunks")
    stream = SE.read_chunk_stream(spark, f"{src}/chunks", T.StructType([*ev.schema.fields, T.StructField("_part", T.IntegerType())]), files_per_trigger=1).drop("_part")
    temporal = _snapshot(spark, SE.streaming_temporal_features(stream, "user_id"), "temporal_stream")
    numeric = _snapshot(spark, SE.streaming_numeric_stats(stream.select("user_id", "value"), "user_id"), "numeric_stream")
    bt = {r[EV.KEY]: _round(r.asDict()) for r in EV.temporal_features(ev, "user_id").collect()}
    assert {k: _round(v) for k, v in temporal.items()} == bt
    cols = ["amplitude_records_count", "amplitude_value_mean", "amplitude_value_std", "amplitude_value_max"]
    bn = {r[EV.KEY]: tuple(round(r[c], 6) for c in cols) for r in EV.event_numeric_stats(ev.select("user_id", "value"), "user_id").collect()}
    assert {k: tuple(round(v[c], 6) for c in cols) for k, v in numeric.items()} == bn
