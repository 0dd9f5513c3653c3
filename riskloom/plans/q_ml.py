"""Training and scoring queries on the documents + labels matrix (rows-only checks)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators import assemble as M
from riskloom.operators import ml as ML
from riskloom.operators import quality as Q
from riskloom.operators import report as RP
from riskloom.operators import splits as SP
from riskloom.plans.catalog import register, table
from riskloom.plans.q_assemble import order_matrix
from riskloom.session import cut_lineage

def _matrix(spark, sf):
    x, feats = order_matrix(spark, sf)
    x = SP.stratified_split(x, M.KEY, "label", 0.2)
    return cut_lineage(SP.stratified_fold(x, M.KEY, "label", 5)), feats


def _trained(spark, sf):
    """Every query trains its own model: its time is the whole time."""
    x, feats = _matrix(spark, sf)
    return x, feats, ML.train_forest(x.where("is_test = 0"), feats)


@register("train_forest")
def q_train_forest(spark, sf):
    x, feats, model = _trained(spark, sf)
    return ML.score(model, x, feats, M.KEY).join(x.select(M.KEY, "label", "is_test"), M.KEY)


@register("score")
def q_score(spark, sf):
    _, feats, model = _trained(spark, sf)
    pm = M.prediction_matrix(table(spark, sf, "orders"), "o_custkey", feats)
    return ML.score(model, pm, feats, M.KEY).withColumn("sample_id", F.col(M.KEY))


@register("feature_importance")
def q_feature_importance(spark, sf):
    _, feats, model = _trained(spark, sf)
    return ML.feature_importance(model, feats, 20)


@register("cv_auc")
def q_cv_auc(spark, sf):
    x, feats = _matrix(spark, sf)
    return ML.cv_auc(x.where("is_test = 0"), feats, "label", "fold", 5)


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    x, feats, model = _trained(spark, sf)
    m = ML.train_test_metrics(model, x, feats, M.KEY)
    path = ML.shared_dir(spark, f"models/fraud_forest-{uuid.uuid4().hex}")
    ML.save_model(model, path, feats, m)
    _, loaded, lfeats, _ = ML.load_first_model([ML.shared_dir(spark, "models/missing"), path])
    a = ML.score(model, x, feats, M.KEY).select(M.KEY, F.col("fraud_probability").alias("p_before"))
    b = ML.score(loaded, x, lfeats, M.KEY).select(M.KEY, F.col("fraud_probability").alias("p_after"))
    return a.join(b, M.KEY).withColumn("same", (F.abs(F.col("p_before") - F.col("p_after")) < 1e-12).cast("int"))


@register("model_info")
def q_model_info(spark, sf):
    x, feats, model = _trained(spark, sf)
    m = ML.train_test_metrics(model, x, feats, M.KEY)
    return ML.model_info(model, feats, m)


@register("training_report")
def q_training_report(spark, sf):
    x, feats, model = _trained(spark, sf)
    m = ML.train_test_metrics(model, x, feats, M.KEY)
    quality = Q.quality_profile(x.select(*feats, "label"), "label")
    return RP.training_report(quality, spark.createDataFrame([tuple(None if v is None else float(v) for v in m.values())], ", ".join(f"{k} double" for k in m)), ML.feature_importance(model, feats, 20))
