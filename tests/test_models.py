import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import functions as F

from oddsmith.operators.evaluate import roc_auc
from oddsmith.operators.models import (
    PenalizedLogit,
    best_model,
    boosted_trees,
    feature_importance,
    model_params,
    random_forest,
    score,
)
from oddsmith.operators.regression import LinearFit
from oddsmith.operators.search import (
    boosted_tree_search,
    boosted_tree_search_short,
    grid_search,
    logistic_search,
    random_forest_search,
    search_results,
)


@pytest.fixture(scope="module")
def planted(spark):
    """2,000 rows whose label follows the first of two features, with noise."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 2))
    y = (x[:, 0] + rng.normal(scale=0.7, size=2000) > 0).astype(int)
    rows = [(i, int(y[i]), Vectors.dense(x[i])) for i in range(2000)]
    return spark.createDataFrame(rows, ["id", "label", "features"]).coalesce(4).cache()


@pytest.mark.parametrize(
    "make, options",
    [(boosted_trees, {"n_trees": 5}), (random_forest, {"n_trees": 10}), (PenalizedLogit, {})],
)
def test_classifiers_find_a_planted_signal(planted, make, options):
    estimator = make(**options)
    model = estimator.fit(planted.drop("id"))
    scored = score(model, planted)
    assert scored.columns == ["id", "label", "features", "score"]
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low < high <= 1
    assert roc_auc(scored, "label", "score").first()["auc"] > 0.85
    again = score(estimator.fit(planted.drop("id")), planted)
    assert scored.exceptAll(again.select(scored.columns)).count() == 0


def test_importances(planted):
    model = random_forest(n_trees=10).fit(planted)
    rows = [tuple(r) for r in feature_importance(model, ["signal", "noise"], planted).collect()]
    assert [name for name, _ in rows] == ["signal", "noise"]
    assert math.isclose(sum(v for _, v in rows), 1.0)
    with pytest.raises(ValueError):
        feature_importance(model, ["one"], planted)
    logit = PenalizedLogit().fit(planted)
    assert feature_importance(logit, ["signal", "noise"], planted).count() == 0


def test_params(planted):
    found = model_params(boosted_trees(max_depth=2, n_trees=2, learning_rate=0.2).fit(planted))
    assert (found["maxDepth"], found["maxIter"], found["stepSize"]) == ("2", "2", "0.2")


@pytest.mark.parametrize("strength", [0.01, 1.0])
def test_penalised_logit_minimises_what_it_says(planted, strength):
    """The gradient of C * sum(loss) + penalty vanishes at the fit."""
    data = planted.select("label", vector_to_array("features").alias("x")).collect()
    x = np.array([r["x"] for r in data])
    y = np.array([r["label"] for r in data])

    def loss_gradient(model):
        w, b = model.coefficients.toArray(), model.intercept
        residual = 1 / (1 + np.exp(-(x @ w + b))) - y
        return strength * (x.T @ residual), strength * residual.sum(), w

    l2 = PenalizedLogit(C=strength, penalty="l2").fit(planted)
    gradient, intercept, w = loss_gradient(l2)
    assert np.allclose(gradient, -w, atol=5e-3) and abs(intercept) < 5e-3
    l1 = PenalizedLogit(C=strength, penalty="l1").fit(planted)
    gradient, intercept, w = loss_gradient(l1)
    for slope, weight in zip(gradient, w):
        assert abs(slope + np.sign(weight)) < 2e-2 if weight else abs(slope) <= 1 + 2e-2


def test_unknown_penalty(planted):
    with pytest.raises(ValueError):
        PenalizedLogit(penalty="elastic").fit(planted)


def test_grids_hold_what_they_declare(spark):
    assert len(boosted_tree_search().grid) == 8 * 4 * 8
    assert len(boosted_tree_search_short().grid) == 8 * 4 * 4
    assert len(random_forest_search().grid) == 2 * 7 * 3 * 3
    assert len(logistic_search().grid) == 14
    assert all(s().folds == 4 and s().parallelism == 10 for s in (boosted_tree_search, logistic_search))


def test_grid_search(planted):
    search = logistic_search(strengths=(1e-6, 1.0), penalties=("l1",), folds=3)
    found = grid_search(planted, search, "id")
    rows = search_results(found, planted).collect()
    assert [r["params"] for r in rows] == ["C=1e-06, penalty=l1", "C=1.0, penalty=l1"]
    # Under the heavy penalty no weight is left, so every score ties.
    assert rows[0]["mean_auc"] == 0.5 and rows[1]["mean_auc"] > 0.85
    assert best_model(found).coefficients[0] > 0


def test_finished_search_is_saved(planted, tmp_path):
    found = grid_search(planted, logistic_search(strengths=(1.0,), penalties=("l1", "l2"), folds=2), "id")
    found.save(str(tmp_path / "search"))
    again = CrossValidatorModel.load(str(tmp_path / "search"))
    assert again.avgMetrics == found.avgMetrics
    assert model_params(again)["C"] == "1.0" and "regParam" in model_params(again)
    assert model_params(found)["penalty"] in ("l1", "l2")
    one = PenalizedLogit(C=2.0)
    assert model_params(one.fit(planted), one)["C"] == "2.0"


def test_folds_of_one_outcome_have_no_auc(planted):
    alone = planted.filter("label = 0").union(planted.filter("label = 1").limit(1))
    found = grid_search(alone, logistic_search(strengths=(1.0,), penalties=("l2",), folds=2), "id")
    assert 0 <= found.avgMetrics[0] <= 1
    with pytest.raises(Exception):
        grid_search(planted.filter("label = 0"), logistic_search(strengths=(1.0,), folds=2), "id")


def test_plain_folds(planted):
    search = boosted_tree_search(
        depths=(1,), n_trees=(2,), learning_rates=(0.3,), folds=2, stratified=False
    )
    assert search_results(grid_search(planted, search, "id"), planted).first()["mean_auc"] > 0.8


def test_linear_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(scale=0.1, size=500)
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    frame = spark.createDataFrame(rows, "a double, b double, y double")
    for intercept in (True, False):
        design = np.column_stack([x, np.ones(500)]) if intercept else x
        exact, *_ = np.linalg.lstsq(design, y, rcond=None)
        fit = LinearFit(frame, ["a", "b"], "y", fit_intercept=intercept)
        assert np.allclose(list(fit.coefficients.values()), exact[:2], atol=1e-9)
        assert math.isclose(fit.intercept, exact[2] if intercept else 0.0, abs_tol=1e-9)
        error = y - design @ exact
        assert math.isclose(fit.explained_variance(), 1 - error.var() / y.var(), rel_tol=1e-9)
        assert dict(tuple(r) for r in fit.terms().collect()).keys() == {"a", "b", "intercept"}
        predicted = fit.predict(output="guess")
        assert predicted.columns == ["a", "b", "y", "guess"]
