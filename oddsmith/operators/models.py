"""Classifiers, scores, importances and parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from oddsmith.sources.small import small_frame

LABEL = "label"


def boosted_trees(
    max_depth: int = 3, learning_rate: float = 0.05, n_trees: int = 100, seed: int = 422, **options
) -> GBTClassifier:
    """Gradient-boosted trees. Every tree builds on the one before, so the plan
    grows; it is cut at each checkpoint where the session has a folder for them."""
    return GBTClassifier(
        labelCol=LABEL,
        maxDepth=max_depth,
        stepSize=learning_rate,
        maxIter=n_trees,
        seed=seed,
        **options,
    )


def random_forest(
    max_depth: int = 5, n_trees: int = 100, seed: int = 42, **options
) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=LABEL, maxDepth=max_depth, numTrees=n_trees, seed=seed, **options
    )


class PenalizedLogit(
    Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Logistic regression set by an inverse penalty strength ``C``.

    It minimises ``C * sum(loss) + penalty``. Spark averages the loss over rows, so
    ``C`` means ``regParam = 1 / (C * rows)``, which only a fit can know: a fold
    has fewer rows than the whole. ``rows`` tells how many there are, if known; otherwise
    a fit counts them.
    """

    C = Param(Params._dummy(), "C", "inverse penalty strength", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "l1 or l2", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    rows = Param(Params._dummy(), "rows", "rows to fit, 0 if not known", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, C=1.0, penalty="l2", maxIter=100, featuresCol="features", labelCol=LABEL):
        super().__init__()
        self._setDefault(
            C=1.0, penalty="l2", maxIter=100, rows=0, featuresCol="features", labelCol=LABEL
        )
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        penalty = self.getOrDefault(self.penalty)
        if penalty not in ("l1", "l2"):
            raise ValueError(f"penalty is 'l1' or 'l2', not {penalty!r}")
        rows = self.getOrDefault(self.rows) or dataset.count()
        return LogisticRegression(
            featuresCol=self.getFeaturesCol(),
            labelCol=self.getLabelCol(),
            maxIter=self.getOrDefault(self.maxIter),
            regParam=1.0 / (self.getOrDefault(self.C) * rows),
            elasticNetParam=float(penalty == "l1"),
            standardization=False,
        ).fit(dataset)


def with_rows(estimator: Estimator, rows: int) -> Estimator:
    """The estimator, told the number of rows if that is a parameter of it."""
    if not isinstance(estimator, PenalizedLogit):
        return estimator
    return estimator.copy({estimator.rows: rows})


def best_model(model: Model) -> Model:
    """The model a search found best, and the classifier inside a pipeline."""
    if isinstance(model, CrossValidatorModel):
        return best_model(model.bestModel)
    if isinstance(model, PipelineModel):
        return best_model(model.stages[-1])
    return model


def score(model: Model, df: DataFrame, output: str = "score") -> DataFrame:
    """Add the probability of a true outcome; the model's other columns are dropped."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(output))


def feature_importance(model: Model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """``feature``, ``importance`` in falling order; no rows for a model without."""
    found = getattr(best_model(model), "featureImportances", None)
    rows = [] if found is None else list(zip(names, found.toArray().tolist(), strict=True))
    frame = small_frame(df.sparkSession, rows, "feature string, importance double")
    return frame.orderBy(frame.importance.desc(), frame.feature)


def model_params(model: Model, estimator: Estimator | None = None) -> dict[str, str]:
    """All parameters of the fitted model, set or default, as text; beside them those of
    the estimator that made it, which a search has chosen (``C`` and ``penalty`` are not
    parameters of the inner model)."""
    found = {}
    if isinstance(model, CrossValidatorModel):
        metrics = model.avgMetrics
        at = max(range(len(metrics)), key=lambda i: (not math.isnan(metrics[i]), metrics[i]))
        estimator = model.getEstimator().copy(model.getEstimatorParamMaps()[at])
    if estimator is not None and not isinstance(estimator, Pipeline):
        found.update({param.name: str(value) for param, value in estimator.extractParamMap().items()})
        found.pop("rows", None)
    inner = best_model(model)
    found.update({param.name: str(value) for param, value in inner.extractParamMap().items()})
    return dict(sorted(found.items()))
