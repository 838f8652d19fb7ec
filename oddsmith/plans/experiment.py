"""Whole experiments: one frame with roles, split by date, encoded, fitted, scored.

The table stays in Spark. What reaches the driver is fitted values (means,
categories, models), one AUC per split, and the run-log entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.functions import required_outcome
from oddsmith.operators.evaluate import compare_with_baseline, roc_auc, roc_points
from oddsmith.operators.features import FeatureEncoder, feature_names
from oddsmith.operators.keys import primary_key_check
from oddsmith.operators.models import LABEL, best_model, feature_importance, model_params, score
from oddsmith.operators.profile import split_shapes, target_distribution
from oddsmith.operators.schema import project_roles
from oddsmith.operators.search import Search
from oddsmith.operators.split import DateSplit
from oddsmith.plans.runlog import RunId, run_log_rows
from oddsmith.session import kept, placed, require_checkpoints
from oddsmith.sources.small import small_frame

SCORE = "score"
COUNT = "n"
FEATURES = "features"


@dataclass(frozen=True)
class ExperimentData:
    """A table and the roles of its columns."""

    df: DataFrame
    target: str
    features: Sequence[str]
    key: str
    dates: DateSplit

    def check_key(self) -> DataFrame:
        return primary_key_check(self.df, self.key)

    def rows(self, *splits: str) -> DataFrame:
        """Key, split, label and features of the named splits, or of all three.

        Dates and columns are cut at the scan. A target that is neither 0 nor 1
        fails the query.
        """
        cut = self.dates.apply(self.df, *splits)
        label = required_outcome(F.col(self.target), self.target).alias(LABEL)
        features = [name for name in self.features if name not in (self.key, self.target)]
        return project_roles(cut, features, self.target, self.key, self.dates.split).select(
            self.key, self.dates.split, label, *features
        )

    def shapes(self) -> DataFrame:
        return split_shapes(self.rows(), len(self.features), self.dates.split)

    def target_shares(self) -> DataFrame:
        return target_distribution(self.rows(), LABEL, self.dates.split)


@dataclass(frozen=True)
class PreparedData:
    """A fitted encoder, shared by every run on the same data.

    Encoding is a row-wise projection of a column-pruned scan. Runs repeat it
    rather than keep the encoded table, which is wider than what it is made from.
    """

    data: ExperimentData
    encoder: Model
    names: list[str]
    train: DataFrame | None = None

    def train_rows(self) -> DataFrame:
        """Key, label and feature vector of the train rows."""
        return self.rows("train").drop(self.data.dates.split) if self.train is None else self.train

    @contextmanager
    def kept_train(self) -> Iterator[PreparedData]:
        """The same data with the encoded train rows kept, for several fits."""
        with kept(self.train_rows()) as train:
            yield replace(self, train=train)

    def rows(self, *splits: str) -> DataFrame:
        """Key, split, label and feature vector."""
        encoded = self.encoder.transform(self.data.rows(*splits))
        return encoded.select(self.data.key, self.data.dates.split, LABEL, FEATURES)


def fit_on(
    train: DataFrame, estimator: Estimator, key: str, partitions: int | None = None
) -> Model:
    """Fit an estimator on rows with a key, a label and features. ``partitions`` places
    the rows, see ``placed``; otherwise they are used as they lie."""
    require_checkpoints(train.sparkSession, estimator)
    return estimator.fit(placed(train, partitions, key).drop(key))


def prepare(
    data: ExperimentData,
    encoder: FeatureEncoder | Estimator,
    names: Callable[[Model], list[str]] | None = None,
) -> PreparedData:
    """Fit the encoder, on train rows only.

    Any estimator will do whose model adds a vector ``features``; ``names`` tells
    the features of one that is no ``FeatureEncoder``.
    """
    fitted = encoder.fit(data.rows("train"))
    if names is not None:
        return PreparedData(data, fitted, names(fitted))
    return PreparedData(data, fitted, feature_names(fitted, getattr(encoder, "prefix", "")))


@dataclass(frozen=True)
class Run:
    """What a run leaves behind. ``model`` takes raw rows and needs no encoder."""

    run: RunId
    model: PipelineModel
    fitted: Model
    aucs: dict[str, float | None]
    metrics: DataFrame
    importances: DataFrame
    log: DataFrame
    counts: DataFrame

    def roc(self) -> DataFrame:
        """The ROC curve of each split as a table, from the kept counts per score."""
        return roc_points(self.counts, LABEL, SCORE, self.counts.columns[0], weight=COUNT)

    def release(self) -> None:
        """Drop the kept counts; a later ``roc`` scores anew."""
        self.counts.unpersist()


def run_experiment(
    prepared: PreparedData,
    estimator: Estimator | Search,
    *,
    splits: Sequence[str] = ("train", "val"),
    baseline_auc: float | None = None,
    description: str = "",
    experiment_id: int = 0,
    run_name: str | None = None,
    partitions: int | None = None,
) -> Run:
    """Fit on train rows, score the named splits, compute each one's exact AUC.

    The scored rows are counted per split, label and score; only these counts are kept,
    for the AUCs and for ``Run.roc``, until ``Run.release``. The estimators cache
    themselves what they iterate over. ``partitions`` places the train rows.
    """
    spark = prepared.data.df.sparkSession
    key, split = prepared.data.key, prepared.data.dates.split
    train = prepared.train_rows()
    if isinstance(estimator, Search):
        fitted = estimator.fit(train, key, partitions=partitions)
        made_by = estimator.estimator
    else:
        fitted = fit_on(train, estimator, key, partitions)
        made_by = estimator
    model = best_model(fitted)
    scored = score(model, prepared.rows(*splits), SCORE)
    counts = scored.groupBy(split, LABEL, SCORE).agg(F.count(F.lit(1)).alias(COUNT))
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    found = {row[split]: row["auc"] for row in roc_auc(counts, LABEL, SCORE, split, weight=COUNT).collect()}
    aucs = {name: found.get(name) for name in splits}
    metrics = small_frame(spark, list(aucs.items()), f"{split} string, auc double")
    if baseline_auc is not None:
        metrics = compare_with_baseline(metrics, baseline_auc)
    importances = feature_importance(model, prepared.names, prepared.data.df)
    run = RunId(experiment_id, run_name=run_name) if run_name else RunId(experiment_id)
    log = run_log_rows(
        spark,
        run,
        description=description,
        baseline_auc=baseline_auc,
        aucs=aucs,
        importances={row["feature"]: row["importance"] for row in importances.collect()},
        params=model_params(fitted, made_by),
        feature_names=prepared.data.features,
    )
    whole = PipelineModel([prepared.encoder, model])
    return Run(run, whole, fitted, aucs, metrics, importances, log, counts)


def run_experiments(
    prepared: PreparedData, estimators: Mapping[str, Estimator | Search], **options
) -> dict[str, Run]:
    """One run per estimator on the same data and encoder, described by its name. The
    encoded train rows are kept once for all of them; so folds are those of the same
    rows, too."""
    with prepared.kept_train() as shared:
        return {
            name: run_experiment(shared, estimator, description=name, **options)
            for name, estimator in estimators.items()
        }
