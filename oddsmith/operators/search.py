"""Grid search by exact AUC over stratified folds."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.operators.boosting import SecondOrderModel, SecondOrderTrees, fit_grid
from oddsmith.operators.evaluate import RocAuc, roc_auc
from oddsmith.operators.features import FeatureEncoder
from oddsmith.operators.models import (
    LABEL,
    PenalizedLogit,
    random_forest,
    score,
    with_rows,
)
from oddsmith.operators.split import assign_folds
from oddsmith.session import kept, placed, require_checkpoints
from oddsmith.sources.small import small_frame

# Candidates whose scores of the left-out rows come from one pass.
MODELS_PER_PASS = 8


@dataclass(frozen=True)
class Search:
    """An estimator, the parameter sets to try, and how to compare them."""

    estimator: Estimator
    grid: list[dict]
    folds: int = 4
    parallelism: int = 10
    seed: int = 42
    stratified: bool = True

    def fit(self, train: DataFrame, key: str | Sequence[str], label: str = LABEL, **options):
        return grid_search(train, self, key, label, **options)


def _grid(choices: dict) -> list[dict]:
    builder = ParamGridBuilder()
    for param, values in choices.items():
        builder.addGrid(param, list(values))
    return builder.build()


# The ready-made grids below are fixed values.


def boosted_tree_search(
    depths=range(2, 10),
    n_trees=(50, 100, 150, 200),
    learning_rates=(0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.2, 0.3),
    **options,
) -> Search:
    """256 parameter sets of second-order trees: 64 fits a fold, see ``fit_grid``."""
    trees = SecondOrderTrees()
    grid = {trees.maxDepth: depths, trees.maxIter: n_trees, trees.stepSize: learning_rates}
    return Search(trees, _grid(grid), **options)


def boosted_tree_search_short(
    depths=range(2, 10),
    n_trees=(60, 100, 140, 180),
    learning_rates=(0.3, 0.1, 0.01, 0.05),
    **options,
) -> Search:
    """128 parameter sets: other tree counts, four rates; 32 fits a fold."""
    return boosted_tree_search(depths, n_trees, learning_rates, **options)


def random_forest_search(
    bootstrap=(True, False),
    depths=range(2, 16, 2),
    features_per_split=("sqrt",),
    rows_per_leaf=(1, 2, 4),
    n_trees=(100, 200, 300),
    **options,
) -> Search:
    """126 parameter sets. Choosing features "auto" and by "sqrt" is one thing for a
    classifier, so the grid has it once; a least size of nodes to split (2, 5 or
    10) is no parameter of Spark's forest."""
    forest = random_forest()
    grid = {
        forest.bootstrap: bootstrap,
        forest.maxDepth: depths,
        forest.featureSubsetStrategy: features_per_split,
        forest.minInstancesPerNode: rows_per_leaf,
        forest.numTrees: n_trees,
    }
    return Search(forest, _grid(grid), **options)


def logistic_search(
    strengths=(0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0), penalties=("l1", "l2"), **options
) -> Search:
    """14 parameter sets."""
    logit = PenalizedLogit()
    return Search(logit, _grid({logit.C: strengths, logit.penalty: penalties}), **options)


def grid_search(
    train: DataFrame,
    search: Search,
    key: str | Sequence[str],
    label: str = LABEL,
    *,
    partitions: int | None = None,
    checkpoints: str | None = None,
    encoder: FeatureEncoder | None = None,
) -> CrossValidatorModel:
    """Fit every parameter set on all folds but one, each fold left out once, then
    the best set on all train rows.

    ``train`` holds the key, the label and whatever the estimator reads. Folds come
    from the key hash, so no row changes its fold when a task runs again. The rows are
    kept once; fold sizes are counted once; the candidates of a fold are scored
    together, and one grouped job finds their AUCs. ``partitions`` places the rows, see
    ``placed``. A fold whose left-out rows have one outcome has no AUC and no part in the
    mean; a candidate without any AUC has NaN.

    An encoder fitted beforehand has seen all train rows. With ``encoder`` the rows are raw,
    and each fold's models see them through an encoder that knows nothing of the fold: all
    of these come from one pass, see ``FeatureEncoder.fit_without``. The model is then a
    pipeline that takes raw rows, its encoder fitted to all. Any other preprocessing
    can be refitted by a search over a ``Pipeline``.

    Sets of ``SecondOrderTrees`` are fitted in shared passes. Those that differ in their
    number of trees alone are one fit, judged on the way; no row placement changes it.
    """
    require_checkpoints(train.sparkSession, search.estimator, checkpoints)
    keys = [key] if isinstance(key, str) else list(key)
    folded = assign_folds(
        train, keys, search.folds, search.seed, stratify=label if search.stratified else ()
    )
    if isinstance(search.estimator, SecondOrderTrees):
        if encoder is not None:
            raise ValueError("fits that share their passes share their features: fit the encoder beforehand")
        model, means = _staged(folded.drop(*keys), search)
        return _validated(search, label, model, means)
    with kept(placed(folded, partitions, *keys).drop(*keys)) as rows:
        sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
        total = sum(sizes.values())
        found: list[list[float]] = [[] for _ in search.grid]
        encoders = encoder.fit_without(rows, "fold", search.folds) if encoder else []
        for fold in range(search.folds):
            others = rows.where(F.col("fold") != fold).drop("fold")
            left_out = rows.where(F.col("fold") == fold).drop("fold")
            if encoders:
                others, left_out = (encoders[fold].transform(part).select(label, encoder.output) for part in (others, left_out))
            models = _fit_all(with_rows(search.estimator, total - sizes.get(fold, 0)), others, search)
            for at, auc in _aucs(models, left_out, label).items():
                found[at].append(auc)
        means, best = _judged(found)
        best_one = with_rows(search.estimator, total)
        if encoder is None:
            model = best_one.fit(rows.drop("fold"), search.grid[best])
        else:
            fitted = encoder.fit(rows.drop("fold"))
            encoded = fitted.transform(rows).select(label, encoder.output)
            model = PipelineModel([fitted, best_one.fit(encoded, search.grid[best])])
    return _validated(search, label, model, means)


def _judged(found: Sequence[Sequence[float]]) -> tuple[list[float], int]:
    """The mean AUC of each candidate, and the best, the first of equal ones."""
    means = [sum(aucs) / len(aucs) if aucs else math.nan for aucs in found]
    if all(math.isnan(mean) for mean in means):
        raise ValueError("no fold has both outcomes, so no candidate has an AUC")
    return means, max(range(len(means)), key=lambda i: (not math.isnan(means[i]), means[i]))


def _staged(rows: DataFrame, search: Search) -> tuple[SecondOrderModel, list[float]]:
    """One fit for all sets that differ in their number of trees alone."""
    trees = search.estimator
    own = [trees.copy(params) for params in search.grid]
    counts = [one.getOrDefault(trees.maxIter) for one in own]
    alike = [(one.options(), one.getOrDefault(trees.maxBins)) for one in own]
    if len({bins for _, bins in alike}) > 1:
        raise ValueError("the sets of one search share their bins: maxBins is no choice of a grid")
    fits = list(dict.fromkeys(alike))
    of_set = [fits.index(one) for one in alike]
    stages = [sorted({n for n, at in zip(counts, of_set) if at == fit}) for fit in range(len(fits))]
    estimators = [own[of_set.index(fit)] for fit in range(len(fits))]
    grid = fit_grid(rows, estimators, stages, search.folds, lambda df: roc_auc(df, "label", "score", "fit", weight="weight"))
    keys = [[(fit, n, fold) for fold in range(search.folds)] for fit, n in zip(of_set, counts)]
    means, best = _judged([[grid.aucs[key] for key in some if key in grid.aucs] for some in keys])
    return own[best].model(grid.trees[of_set[best]][: counts[best]], grid.cuts), means


def _validated(search: Search, label: str, model: Model, means: list[float]) -> CrossValidatorModel:
    validator = CrossValidator(
        estimator=search.estimator,
        estimatorParamMaps=search.grid,
        evaluator=RocAuc(label),
        numFolds=search.folds,
        foldCol="fold",
        parallelism=search.parallelism,
        seed=search.seed,
    )
    return validator._copyValues(CrossValidatorModel(model, means))


def _fit_all(estimator: Estimator, rows: DataFrame, search: Search) -> list[Model]:
    models: list[Model | None] = [None] * len(search.grid)
    fits = estimator.fitMultiple(rows, search.grid)
    with ThreadPool(min(search.parallelism, len(search.grid))) as pool:
        for at, model in pool.imap_unordered(lambda _: next(fits), range(len(search.grid))):
            models[at] = model
    return models


def _aucs(models: Sequence[Model], rows: DataFrame, label: str) -> dict[int, float]:
    """The AUC of each model that has one; so many models at once share a pass."""
    found = {}
    for first in range(0, len(models), MODELS_PER_PASS):
        part = range(first, min(first + MODELS_PER_PASS, len(models)))
        scored = rows
        for at in part:
            scored = score(models[at], scored, f"_score_{at}")
        each = [F.struct(F.lit(at).alias("_at"), F.col(f"_score_{at}").alias("_score")) for at in part]
        stacked = scored.select(F.col(label).alias("_label"), F.inline(F.array(*each)))
        for row in roc_auc(stacked, "_label", "_score", "_at").collect():
            if row["auc"] is not None:
                found[row["_at"]] = row["auc"]
    return found


def search_results(model: CrossValidatorModel, df: DataFrame) -> DataFrame:
    """Mean AUC over the folds for each parameter set."""
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda x: x[0].name)), auc)
        for i, (params, auc) in enumerate(zip(model.getEstimatorParamMaps(), model.avgMetrics))
    ]
    return small_frame(df.sparkSession, rows, "candidate int, params string, mean_auc double")
