"""Training, scoring and persistence with Spark ML.

Pipeline: exact median imputation -> standardisation -> vector assembly -> random forest.  The
imputer and scaler (``stages``) are fitted on the training part only (the source fitted them on all
rows).  The model lives in a ``PipelineModel`` directory under the session's shared folder.
"""

from __future__ import annotations

import json
import statistics
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import risk as R
from riskloom.operators import labels as L
from riskloom.operators import metrics as MT
from riskloom.operators.stages import MedianImputer, PopulationScaler, fold_stages
from riskloom.session import checkpoint_dir, cut_lineage

# Forest presets (default, and the imbalanced preset used when the positive
# share is below 10 %).  Spark has no minimum-split setting; min instances per node is the
# leaf minimum.
DEFAULT_FOREST = dict(numTrees=100, maxDepth=10, minInstancesPerNode=2)
IMBALANCED_FOREST = dict(numTrees=200, maxDepth=15, minInstancesPerNode=5)
IMBALANCED_BELOW = 0.1
SEED = 42


def shared_dir(spark: SparkSession, sub: str) -> str:
    """A folder under the cluster's shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{sub}"


def build_pipeline(features: list[str], label: str = "label", weight: str | None = None,
                   forest: dict | None = None, fitted: tuple | None = None) -> Pipeline:
    """``fitted``: an imputer and a scaler that are fitted already."""
    imputed, scaled = [f"_imp_{c}" for c in features], [f"_std_{c}" for c in features]
    rf = RandomForestClassifier(featuresCol="_scaled", labelCol=label, seed=SEED, probabilityCol="_prob",
                                rawPredictionCol="_raw", predictionCol="_pred", **(forest or DEFAULT_FOREST))
    if weight:
        rf = rf.setWeightCol(weight)
    first = fitted or (MedianImputer(inputCols=features, outputCols=imputed), PopulationScaler(inputCols=imputed, outputCols=scaled))
    return Pipeline(stages=[*first, VectorAssembler(inputCols=scaled, outputCol="_scaled", handleInvalid="keep"), rf])


def train_forest(train: DataFrame, features: list[str], label: str = "label", preset: str = "auto", fitted: tuple | None = None) -> PipelineModel:
    """Fit the pipeline; ``auto`` switches to the weighted imbalanced preset below 10 %."""
    rate = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    imbalanced = preset == "imbalanced" or (preset == "auto" and rate < IMBALANCED_BELOW)
    x = train.select(*features, F.col(label).cast("double").alias(label))
    x = _as_numbers(x, features)
    if imbalanced:
        x = L.with_class_weight(x, label, "_w")
        return build_pipeline(features, label, "_w", IMBALANCED_FOREST, fitted).fit(x)
    return build_pipeline(features, label, fitted=fitted).fit(x)


def _as_numbers(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") if c in df.columns else F.lit(0.0) for c in features})


def score(model: PipelineModel, df: DataFrame, features: list[str], key: str, carry: list[str] = ()) -> DataFrame:
    """Scoring table: key, prediction, fraud probability, both band columns.  A missing column is 0,
    a missing value is left to the model's median imputer."""
    out = model.transform(_as_numbers(df, features))
    p = vector_to_array("_prob")[1]
    return out.select(key, *carry, F.col("_pred").cast("int").alias("prediction"), p.alias("fraud_probability"),
                      R.band_by_cut(p).alias("risk_level"), R.band_by_threshold(p).alias("risk_level_rule"))


def feature_importance(model: PipelineModel, features: list[str], top_n: int = 20) -> DataFrame:
    rf = model.stages[-1]
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, rf.featureImportances.toArray())]  # one row per feature
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(top_n)


def fold_aucs(train: DataFrame, features: list[str], label: str = "label", fold: str = "fold", k: int = 5, parallel: int = 5) -> list[float | None]:
    """The exact AUC of every fold by a model of the others; None for a fold of one class.

    Medians, means and deviations of all folds come from one plan each; the folds' forests are then fitted and
    scored side by side, ``parallel`` at a time, as jobs of one session."""
    x = _as_numbers(train, features)
    imputed, scaled = [f"_imp_{c}" for c in features], [f"_std_{c}" for c in features]
    stages = fold_stages(x, fold, k, features, imputed, scaled)

    def auc_of(i: int) -> float | None:
        model = train_forest(train.where(F.col(fold) != i), features, label, fitted=stages[i])
        scored = model.transform(x.where(F.col(fold) == i)).select(vector_to_array("_prob")[1].alias("p"), F.col(label))
        return MT.auc(scored, "p", label).first()["auc"]

    with ThreadPoolExecutor(parallel) as pool:  # threads only submit jobs
        return list(pool.map(inheritable_thread_target(train.sparkSession)(auc_of), range(k)))


def cv_auc(train: DataFrame, features: list[str], label: str = "label", fold: str = "fold", k: int = 5) -> DataFrame:
    """Mean and population std of the held-out-fold AUC over all ``k`` folds (exact).  A fold that has
    one class only has no AUC (stratified folds avoid it while a class has ``k`` keys); then
    ``scored_folds`` is less than ``folds`` and mean and std are NULL, not those of fewer folds."""
    aucs = [a for a in fold_aucs(train, features, label, fold, k) if a is not None]
    whole = len(aucs) == k
    return train.sparkSession.createDataFrame(
        [(k, len(aucs), statistics.fmean(aucs) if whole else None, statistics.pstdev(aucs) if whole else None)],
        "folds int, scored_folds int, cv_auc_mean double, cv_auc_std double")


def train_test_metrics(model: PipelineModel, x: DataFrame, features: list[str], key: str, label: str = "label") -> dict:
    """Test-side metrics, and the train side's with prefix ``train_``, with both sizes."""
    scored = cut_lineage(score(model, x, features, key, carry=[label, "is_test"]))
    out = {}
    for prefix, part in (("", 1), ("train_", 0)):
        rows = scored.where(F.col("is_test") == part)
        out |= {prefix + k: v for k, v in MT.classification_metrics(rows, "fraud_probability", label).first().asDict().items()}
        out[prefix + "average_precision"] = MT.average_precision(rows, "fraud_probability", label).first()[0]
    best = MT.threshold_at_precision(scored.where("is_test = 1"), 0.8, "fraud_probability", label).first()
    return out | {"threshold_at_80": best["threshold"], "recall_at_80": best["recall"]}


def save_model(model: PipelineModel, path: str, features: list[str], metrics: dict) -> None:
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    meta = json.dumps({"features": features, "metrics": metrics}, ensure_ascii=False)
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(path: str) -> tuple[PipelineModel, list[str], dict]:
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    return PipelineModel.load(f"{path}/pipeline"), meta["features"], meta["metrics"]


def load_first_model(paths: list[str]) -> tuple[str, PipelineModel, list[str], dict] | None:
    """The first of the model folders that is there, with its path; None if none is.  A folder that is there and cannot
    be loaded (permissions, versions) is an error, not a missing model."""
    for p in paths:
        try:
            return p, *load_model(p)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return None


def model_info(model: PipelineModel, features: list[str], metrics: dict) -> DataFrame:
    rf = model.stages[-1]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(
        "RandomForestClassifier", len(features), rf.getNumTrees, rf.getOrDefault("maxDepth"),
        rf.getOrDefault("minInstancesPerNode"), json.dumps(metrics, ensure_ascii=False))],
        "model_type string, n_features int, n_trees int, max_depth int, min_instances_per_node int, metrics string")


