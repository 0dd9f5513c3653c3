"""Preprocessing stages of the training pipeline as estimators and models that are saved with it.

Both are fitted by distributed plans whose result is one row: the exact medians by the quantile plan, means and population
deviations by one aggregate.  Their models are projections with literals.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import quantiles as QT


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`").cast("double")


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Input columns and the output column of each."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, **values):
        super().__init__()
        self._set(**self._input_kwargs)


class MedianImputer(Estimator, _Columns):
    """NULL or NaN becomes the column's exact median; a column without a value gets 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super(Estimator, self).__init__(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianModel:
        cols = self.getInputCols()
        row = QT.exact_quantiles(dataset, [], cols, [0.5], name=lambda c, _: c).first()
        return MedianModel.of(cols, self.getOutputCols(), [row[c] for c in cols] if row else [None] * len(cols))


class MedianModel(Model, _Columns):
    medians = Param(Params._dummy(), "medians", "median of each input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, medians=None):
        super(Model, self).__init__(**self._input_kwargs)

    @classmethod
    def of(cls, cols: list[str], out: list[str], medians: list[float | None]) -> MedianModel:
        return cls(inputCols=cols, outputCols=out, medians=[0.0 if m is None else float(m) for m in medians])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("medians"), strict=True)
        return dataset.withColumns({o: F.coalesce(F.nanvl(_col(c), F.lit(None).cast("double")), F.lit(m)) for c, o, m in values})


class PopulationScaler(Estimator, _Columns):
    """(value - mean) / population standard deviation; 0 where there is no variance."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super(Estimator, self).__init__(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ScalerModel:
        cols = self.getInputCols()
        row = dataset.agg(*[F.avg(_col(c)) for c in cols], *[F.stddev_pop(_col(c)) for c in cols]).first()
        return ScalerModel.of(cols, self.getOutputCols(), row[:len(cols)], row[len(cols):])


class ScalerModel(Model, _Columns):
    means = Param(Params._dummy(), "means", "mean of each input column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population standard deviation of each input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, means=None, deviations=None):
        super(Model, self).__init__(**self._input_kwargs)

    @classmethod
    def of(cls, cols: list[str], out: list[str], means, deviations) -> ScalerModel:
        return cls(inputCols=cols, outputCols=out, means=[float(m or 0.0) for m in means], deviations=[float(d or 0.0) for d in deviations])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("means"), self.getOrDefault("deviations"), strict=True)
        return dataset.withColumns({o: (_col(c) - F.lit(m)) / F.lit(d) if d else F.lit(0.0) for c, o, m, d in values})


def fold_stages(train: DataFrame, fold: str, k: int, cols: list[str], imputed: list[str], scaled: list[str]) -> list[tuple[MedianModel, ScalerModel]]:
    """The fitted stages of every fold's training part, all found together: a row counts for the folds it is not held out of, so
    one quantile plan and one aggregate, grouped by the fold left out, serve all of them."""
    out = F.explode(F.filter(F.array(*[F.lit(i) for i in range(k)]), lambda i: i != F.col(fold))).alias("_out")
    parts = train.where(F.col(fold).isNotNull()).select(out, *[_col(c).alias(c) for c in cols])
    medians = {r["_out"]: r for r in QT.exact_quantiles(parts, ["_out"], cols, [0.5], name=lambda c, _: c).collect()}  # a row per fold
    imputers = [MedianModel.of(cols, imputed, [medians[i][c] if i in medians else None for c in cols]) for i in range(k)]
    by_fold = [F.when(F.col("_out") == i, F.coalesce(F.nanvl(_col(c), F.lit(None).cast("double")), F.lit(m)))
               for i, model in enumerate(imputers) for c, m in zip(cols, model.getOrDefault("medians"), strict=True)]
    row = parts.agg(*[F.avg(x) for x in by_fold], *[F.stddev_pop(x) for x in by_fold]).first()
    n = len(cols)
    return [(imputers[i], ScalerModel.of(imputed, scaled, row[i * n:(i + 1) * n], row[(k + i) * n:(k + i + 1) * n])) for i in range(k)]
