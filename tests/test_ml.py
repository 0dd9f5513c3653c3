"""Pipeline stages against the operators they stand for, their persistence, and cross-validation by folds."""

from __future__ import annotations

import math
import random
import statistics
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import metrics as MT
from riskloom.operators import ml as ML
from riskloom.operators import quality as Q
from riskloom.operators.stages import MedianImputer, PopulationScaler, fold_stages


@pytest.fixture(scope="module")
def matrix(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        label = int(rnd.random() < 0.3)
        rows.append((i, i % 5, label, rnd.gauss(label, 1), None if rnd.random() < 0.2 else rnd.choice([1.0, 2.0, 5.0]), float("nan") if i % 11 == 0 else rnd.random(), None))
    return spark.createDataFrame(rows, "id int, fold int, label int, a double, `b.x` double, c double, empty double").repartition(3).checkpoint()


COLS = ["a", "b.x", "c"]


def test_stages_equal_the_operators(spark, matrix):
    imputed, scaled = [f"i{k}" for k in range(4)], [f"s{k}" for k in range(4)]
    model = Pipeline(stages=[MedianImputer(inputCols=[*COLS, "empty"], outputCols=imputed), PopulationScaler(inputCols=imputed, outputCols=scaled)]).fit(matrix)
    path = tempfile.mkdtemp(prefix="riskloom-model-") + "/m"
    model.write().save(path)
    loaded = PipelineModel.load(path)
    got = {r["id"]: r for r in loaded.transform(matrix).collect()}
    plain = matrix.withColumn("c", F.nanvl("c", F.lit(None).cast("double")))
    by_operator = Q.impute_median(plain.select("id", *[F.col(f"`{c}`") for c in COLS]), COLS)
    want = {r["id"]: r for r in by_operator.collect()}
    std = {r["id"]: r for r in Q.standardize(by_operator, COLS).collect()}
    for i, r in got.items():
        assert [r[c] for c in imputed[:3]] == [want[i][c] for c in COLS] and r["i3"] == 0.0
        assert [r[c] for c in scaled[:3]] == pytest.approx([std[i][c] for c in COLS], abs=1e-12) and r["s3"] == 0.0
    exact = statistics.median(r["a"] for r in matrix.collect())
    assert loaded.stages[0].getOrDefault("medians")[0] == exact


def test_fold_stages_are_those_of_each_training_part(matrix):
    imputed, scaled = ["i0", "i1", "i2"], ["s0", "s1", "s2"]
    for i, (imputer, scaler) in enumerate(fold_stages(matrix, "fold", 5, COLS, imputed, scaled)):
        part = matrix.where(F.col("fold") != i)
        one = MedianImputer(inputCols=COLS, outputCols=imputed).fit(part)
        two = PopulationScaler(inputCols=imputed, outputCols=scaled).fit(one.transform(part))
        assert imputer.getOrDefault("medians") == one.getOrDefault("medians")
        for p in ("means", "deviations"):
            assert scaler.getOrDefault(p) == pytest.approx(two.getOrDefault(p), rel=1e-12)


def test_folds_side_by_side_equal_one_after_another(matrix, monkeypatch):
    monkeypatch.setattr(ML, "DEFAULT_FOREST", dict(numTrees=5, maxDepth=3, minInstancesPerNode=2))
    x = matrix.withColumnRenamed("b.x", "b")
    cols = ["a", "b", "c"]
    got = ML.fold_aucs(x, cols)
    want = []
    for i in range(5):
        model = ML.train_forest(x.where(F.col("fold") != i), cols)
        scored = model.transform(x.where(F.col("fold") == i)).select(vector_to_array("_prob")[1].alias("p"), "label")
        want.append(MT.auc(scored, "p", "label").first()["auc"])
    assert got == pytest.approx(want, abs=1e-12) and statistics.fmean(got) > 0.6
    row = ML.cv_auc(x, cols).first()
    assert row["scored_folds"] == 5 and row["cv_auc_std"] == pytest.approx(statistics.pstdev(want))
    one_class = ML.cv_auc(x.withColumn("label", F.when(F.col("fold") == 0, 0).otherwise(F.col("label"))), cols).first()
    assert one_class["scored_folds"] == 4 and one_class["cv_auc_mean"] is None


def test_only_a_missing_model_is_passed_over(spark, matrix, monkeypatch):
    monkeypatch.setattr(ML, "DEFAULT_FOREST", dict(numTrees=2, maxDepth=2, minInstancesPerNode=2))
    base = tempfile.mkdtemp(prefix="riskloom-model-")
    model = ML.train_forest(matrix, ["a", "c"])
    ML.save_model(model, f"{base}/there", ["a", "c"], {"auc": 0.5})
    path, loaded, features, metrics = ML.load_first_model([f"{base}/missing", f"{base}/there"])
    assert path == f"{base}/there" and features == ["a", "c"] and metrics == {"auc": 0.5}
    a, b = ({r["id"]: r["fraud_probability"] for r in ML.score(m, matrix, features, "id").collect()} for m in (model, loaded))
    assert a == b and not any(math.isnan(p) for p in a.values())
    assert ML.load_first_model([f"{base}/missing"]) is None
    spark.range(1).selectExpr("'{' AS meta").coalesce(1).write.text(f"{base}/broken/meta")
    with pytest.raises(Exception):  # noqa: B017, PT011  whatever the reader says
        ML.load_first_model([f"{base}/broken", f"{base}/there"])
