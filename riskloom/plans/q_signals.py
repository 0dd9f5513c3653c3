"""Signal queries on ``embeddings`` (64 float samples per row; frame 16, hop 8)."""

from __future__ import annotations

from riskloom.operators import signals as G
from riskloom.plans.catalog import register, table

FRAME, HOP = 16, 8
FR = f"""
s AS (SELECT vec_id, embedding AS x, len(embedding) AS n FROM embeddings),
f AS (SELECT vec_id, x, n, least(n, {FRAME}) AS fl,
             CASE WHEN n >= {FRAME} THEN range(0, n - {FRAME} + 1, {HOP}) ELSE [0] END AS starts FROM s)"""


def _stats_sql(v: str, p: str) -> str:
    return (f"ROUND(COALESCE(list_avg({v}), 0), 6) AS {p}_mean, ROUND(COALESCE(list_aggregate({v}, 'stddev_pop'), 0), 6) AS {p}_std, "
            f"ROUND(COALESCE(list_min({v}), 0), 6) AS {p}_min, ROUND(COALESCE(list_max({v}), 0), 6) AS {p}_max")


@register("signal_rms", f"""WITH {FR},
r AS (SELECT vec_id, CASE WHEN n > 0 THEN list_transform(starts, lambda st: sqrt(list_sum(list_transform(
        list_slice(x, st + 1, st + fl), lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / fl)) END AS v FROM f)
SELECT vec_id, {_stats_sql("v", "rms")} FROM r""")
def q_signal_rms(spark, sf):
    return G.signal_rms_stats(table(spark, sf, "embeddings"), "vec_id", "embedding", FRAME, HOP)


@register("signal_zcr", f"""WITH {FR},
c AS (SELECT *, list_transform(range(n), lambda i: CASE WHEN i = 0 THEN 0
        WHEN (x[i + 1] >= 0) <> (x[i] >= 0) THEN 1 ELSE 0 END) AS cr FROM f),
r AS (SELECT vec_id, CASE WHEN n > 0 THEN list_transform(starts,
        lambda st: CAST(list_sum(list_slice(cr, st + 1, st + fl)) AS DOUBLE) / fl) END AS v FROM c)
SELECT vec_id, {_stats_sql("v", "zcr")} FROM r""")
def q_signal_zcr(spark, sf):
    return G.signal_zcr_stats(table(spark, sf, "embeddings"), "vec_id", "embedding", FRAME, HOP)


@register("signal_profile", """
SELECT vec_id, CAST(COALESCE(len(embedding), 0) AS INTEGER) AS n_samples,
  ROUND(COALESCE(len(embedding), 0) / 22050.0, 6) AS duration, 22050 AS sample_rate,
  CAST(COALESCE(len(embedding), 0) = 0 AS INTEGER) AS audio_processing_error FROM embeddings""")
def q_signal_profile(spark, sf):
    return G.signal_profile(table(spark, sf, "embeddings"), "vec_id", "embedding")


@register("signal_validity", """
SELECT vec_id, CAST(COALESCE(len(embedding), 0) AS INTEGER) AS n_samples,
  CAST(embedding IS NOT NULL AND least(len(embedding), 22050) > 0 AS INTEGER) AS is_valid,
  CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) = 0 THEN 'empty' END AS reject_reason FROM embeddings""")
def q_signal_validity(spark, sf):
    return G.signal_validity(table(spark, sf, "embeddings"), "vec_id", "embedding")


@register("signal_features")
def q_signal_features(spark, sf):
    return G.signal_features(table(spark, sf, "embeddings"), "vec_id", "embedding", n_fft=FRAME, hop=HOP, n_mels=8)
