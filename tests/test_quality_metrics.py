"""Cleaning (FIXTURES §3 F), metrics (K), report and split invariants."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators import quality as Q
from riskloom.operators import report as RP
from riskloom.operators import splits as SP


def test_clean_features_rules(spark):
    t = dt.datetime(2024, 1, 1)
    data = [
        (1, "1", "1", None, 5, 5, float("inf"), t),
        (2, "2", "x", None, 5, None, float("-inf"), t + dt.timedelta(seconds=1)),
        (3, None, None, None, 5, 5, 0.0, t + dt.timedelta(seconds=2)),
    ]
    schema = "id int, s12 string, sx string, allnull string, c5 int, n5 int, infs double, ts timestamp_ntz"
    df = spark.createDataFrame(data, schema)
    out, feats = Q.clean_features(df, keep=("id",))
    assert feats == ["s12", "n5", "ts_timestamp"]
    got = {r["id"]: (r["s12"], r["n5"], r["ts_timestamp"]) for r in out.collect()}
    assert got[3] == (0.0, 5, 1704067202)
    assert got[2] == (2.0, 0, 1704067201)


def test_metrics_small(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "score double, label int")
    assert M.auc(df).first()["auc"] == pytest.approx(0.75)
    assert M.average_precision(df).first()["average_precision"] == pytest.approx(0.833333, abs=1e-6)
    r = M.threshold_at_precision(df, 0.8).first()
    assert r["threshold"] == 0.9 and r["recall"] == 0.5
    none = M.classification_metrics(df, threshold=0.95).first()
    assert none["precision"] == 0.0 and none["f1"] == 0.0


def test_auc_matches_rank_sum_with_ties(spark):
    import random
    rnd = random.Random(7)
    data = [(round(rnd.random(), 2), int(rnd.random() < 0.3)) for _ in range(3000)]
    df = spark.createDataFrame(data, "score double, label int").repartition(5)
    # reference: Mann-Whitney U with ties counted one half
    pos = [s for s, y in data if y == 1]
    neg = sorted(s for s, y in data if y == 0)
    import bisect
    u = sum(bisect.bisect_left(neg, s) + 0.5 * (bisect.bisect_right(neg, s) - bisect.bisect_left(neg, s)) for s in pos)
    assert M.auc(df).first()["auc"] == pytest.approx(u / (len(pos) * len(neg)), abs=1e-12)


def test_confusion_cells_sum_to_n(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = docs.select(F.least(F.col("n_chars") / 10000, F.lit(1.0)).alias("score"),
                     (F.col("doc_id") % 7 == 0).cast("int").alias("label"))
    n = df.count()
    assert M.confusion_matrix(df, threshold=0.1).agg(F.sum("n")).first()[0] == n
    rep = M.class_report(df, threshold=0.1)
    assert rep.agg(F.sum("support")).first()[0] == n


def test_band_counts_sum_to_total(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    scored = ev.select(F.col("event_id").alias("sample_id"), (F.col("value") / 500).alias("fraud_probability"))
    s = RP.risk_summary(scored).first()
    assert s["high"] + s["medium"] + s["low"] == s["total"] == ev.count()


def test_hash_split_is_disjoint_and_complete(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sp = SP.hash_split(docs, "doc_id", 0.2)
    test = {r[0] for r in sp.where("is_test = 1").select("doc_id").collect()}
    train = {r[0] for r in sp.where("is_test = 0").select("doc_id").collect()}
    assert not test & train and len(test | train) == docs.count()
    assert 0.1 < len(test) / docs.count() < 0.3


def test_stratified_split_sizes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    df = docs.join(labels, "doc_id").select("doc_id", "toxic")
    sp = SP.stratified_split(df, "doc_id", "toxic", 0.2)
    got = {(r["toxic"], r["is_test"]): r["n"] for r in sp.groupBy("toxic", "is_test").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = {r["toxic"]: r["n"] for r in df.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    for cls, n in totals.items():
        assert got.get((cls, 1), 0) == int(n * 0.2)
        assert got.get((cls, 0), 0) + got.get((cls, 1), 0) == n
