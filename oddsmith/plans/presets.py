"""The worked experiment: will a lead apply online? Roles, encoder, estimators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame

from oddsmith.operators.features import (
    CodeMap,
    FeatureEncoder,
    KeepList,
    MeanImpute,
    PositiveFlag,
    TrueFlag,
)
from oddsmith.operators.models import boosted_trees
from oddsmith.operators.schema import check_roles
from oddsmith.operators.search import (
    Search,
    boosted_tree_search_short,
    logistic_search,
    random_forest_search,
)
from oddsmith.operators.split import DateSplit, anchor_windows
from oddsmith.plans.experiment import ExperimentData, PreparedData, Run, run_experiments

# Fixed values of the worked experiment.
ANCHOR = "2022-10-30"
EXPERIMENT_ID = 422
BASELINE_AUC = 0.75
KEY = "lead_id"
TARGET = "target"
DATE = "create_date"


def lead_encoder(
    floats: Sequence[str],
    ints: Sequence[str],
    booleans: Sequence[str],
    kept: Mapping[str, Sequence[str]],
    coded: Mapping[str, tuple[Mapping[str, int], int]],
) -> FeatureEncoder:
    """``kept`` lists the values to keep of each category, ``coded`` has the codes of the
    values of others and the code of all else."""
    return FeatureEncoder(
        [
            MeanImpute(list(floats)),
            PositiveFlag(list(ints)),
            TrueFlag(list(booleans)),
            *[KeepList(column, values) for column, values in kept.items()],
            *[CodeMap(column, codes, default) for column, (codes, default) in coded.items()],
        ]
    )


def lead_data(
    df: DataFrame,
    floats: Sequence[str],
    ints: Sequence[str],
    booleans: Sequence[str],
    strings: Sequence[str],
    anchor: str = ANCHOR,
) -> ExperimentData:
    roles = {"boolean": booleans, "float": floats, "int": ints, "string": list(strings)}
    windows = anchor_windows(anchor)
    dates = DateSplit(DATE, windows.val_start, windows.test_start)
    return ExperimentData(df, TARGET, check_roles(df, roles), KEY, dates)


def lead_estimators() -> dict[str, GBTClassifier | Search]:
    """The four runs of the worked experiment, by description."""
    return {
        "boosted-trees": boosted_trees(max_depth=3, learning_rate=0.05, n_trees=100, seed=422),
        "boosted-trees-grid-search": boosted_tree_search_short(),
        "random-forest-grid-search": random_forest_search(),
        "logistic-regression-grid-search": logistic_search(),
    }


def lead_runs(
    prepared: PreparedData, estimators: Mapping[str, GBTClassifier | Search] | None = None, **options
) -> dict[str, Run]:
    """The worked experiment's runs, under its id and against its baseline."""
    estimators = lead_estimators() if estimators is None else estimators
    return run_experiments(
        prepared, estimators, experiment_id=EXPERIMENT_ID, baseline_auc=BASELINE_AUC, **options
    )
