"""Flagship: per-user event features joined with the temporal hour profile and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.stats import round_doubles
from riskloom.operators import events as ev
from riskloom.plans.catalog import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    feats = ev.event_features(events, tiebreak=["event_id"])
    temporal = ev.temporal_features(events)
    sessions = ev.session_features(events, tiebreak=["event_id"])
    return round_doubles(feats.join(temporal, ev.KEY, "left").join(sessions, ev.KEY, "left"))
