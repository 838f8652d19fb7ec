"""Second-order trees against plain loops, prefixes, and grids against single fits."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from oddsmith.operators.boosting import SecondOrderModel, SecondOrderTrees, best_splits, FitOptions, fit_grid
from oddsmith.operators.evaluate import roc_auc
from oddsmith.operators.models import feature_importance, model_params, score
from oddsmith.operators.search import boosted_tree_search, grid_search, search_results
from oddsmith.operators.split import assign_folds
from oddsmith.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def planted(spark):
    """Three features of few values, one with missing values that tell the label."""
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 7, (900, 3)).astype(float)
    x[rng.random(900) < 0.2, 1] = np.nan
    y = ((x[:, 0] > 3) ^ np.isnan(x[:, 1]) ^ (rng.random(900) < 0.15)).astype(int)
    rows = [(i, int(y[i]), Vectors.dense(x[i])) for i in range(900)]
    return spark.createDataFrame(rows, ["id", "label", "features"]).repartition(4).cache(), x, y


def plain_margins(x, y, trees, depth, rate, penalty=1.0, weight=1.0, fitted=None):
    """Trees by the definition, row by row; margins of all rows, fitted on some."""
    fitted = np.ones(len(y), bool) if fitted is None else fitted
    margin = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows, level):
            own = rows & fitted
            G, H = g[own].sum(), h[own].sum()
            best = None
            if level < depth:
                for f in range(x.shape[1]):
                    missing = np.isnan(x[:, f])
                    for cut in np.unique(x[fitted & ~missing, f]):
                        for right in (True, False):
                            if not right and not (missing & own).any():
                                continue
                            goes = np.where(missing, right, x[:, f] >= cut)
                            a, b = own & ~goes, own & goes
                            if min(h[a].sum(), h[b].sum()) < weight:
                                continue
                            gain = 0.5 * (g[a].sum() ** 2 / (h[a].sum() + penalty) + g[b].sum() ** 2 / (h[b].sum() + penalty) - G**2 / (H + penalty))
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, goes)
            if best is None:
                margin[rows] += -rate * G / (H + penalty)
                return
            grow(rows & ~best[1], level + 1)
            grow(rows & best[1], level + 1)

        grow(np.ones(len(y), bool), 0)
    return margin


def test_equals_plain_loops(planted):
    df, x, y = planted
    model = SecondOrderTrees(maxDepth=3, maxIter=4, stepSize=0.3).fit(df)
    found = {r["id"]: r["score"] for r in score(model, df).collect()}
    expected = 1 / (1 + np.exp(-plain_margins(x, y, 4, 3, 0.3)))
    assert np.allclose([found[i] for i in range(len(y))], expected, atol=1e-6)
    assert roc_auc(score(model, df), "label", "score").first()["auc"] > 0.8


def test_the_first_trees_are_the_fit_of_so_many(planted):
    df, _, _ = planted
    whole = SecondOrderTrees(maxDepth=2, maxIter=5, stepSize=0.3, checkpointInterval=2).fit(df)
    part = SecondOrderTrees(maxDepth=2, maxIter=3, stepSize=0.3).fit(df.repartition(7))
    assert whole.first(3).trees == part.trees
    assert model_params(whole.first(3))["maxIter"] == "3"
    a, b = (score(m, df).select("id", "score") for m in (whole.first(3), part))
    assert a.exceptAll(b).isEmpty()


def test_a_grid_equals_its_single_fits(planted):
    df, x, y = planted
    folded = assign_folds(df, ["id"], 2, 42, stratify="label")
    estimators = [SecondOrderTrees(maxDepth=d, maxIter=3, stepSize=r) for d, r in ((1, 0.3), (3, 0.1))]
    grid = fit_grid(folded, estimators, [(1, 3), (3,)], 2, lambda rows: roc_auc(rows, "label", "score", "fit", weight="weight"))
    assert sorted(grid.aucs) == [(0, 1, 0), (0, 1, 1), (0, 3, 0), (0, 3, 1), (1, 3, 0), (1, 3, 1)]
    fold = {r["id"]: r["fold"] for r in folded.collect()}
    fold = np.array([fold[i] for i in range(len(y))])
    for (at, n, out), auc in grid.aucs.items():
        own = estimators[at].options()
        margin = plain_margins(x, y, n, own.depth, own.rate, fitted=fold != out)
        pos, neg = margin[(fold == out) & (y == 1)], margin[(fold == out) & (y == 0)]
        # Sums of other rows' trees round apart in the last digits.
        wins = (pos[:, None] > neg + 1e-9).sum() + 0.5 * (abs(pos[:, None] - neg) <= 1e-9).sum()
        assert math.isclose(auc, wins / (len(pos) * len(neg)), abs_tol=1e-9)
    for at, estimator in enumerate(estimators):
        assert estimator.model(grid.trees[at], grid.cuts).trees == estimator.fit(df).trees


def test_search_takes_the_best_of_its_stages(planted):
    df, _, _ = planted
    search = boosted_tree_search(depths=(1, 2), n_trees=(1, 4), learning_rates=(0.3,), folds=2)
    found = grid_search(df, search, "id")
    rows = search_results(found, df).collect()
    assert [r["params"] for r in rows][:2] == ["maxDepth=1, maxIter=1, stepSize=0.3", "maxDepth=1, maxIter=4, stepSize=0.3"]
    best = max(rows, key=lambda r: r["mean_auc"])
    assert f"maxIter={len(found.bestModel.trees)}," in best["params"]
    assert len({r["mean_auc"] for r in rows}) > 2
    bad = boosted_tree_search(depths=(1,), n_trees=(1,), learning_rates=(0.3,), folds=2)
    bad.grid.append({**bad.grid[0], bad.estimator.maxBins: 7})
    with pytest.raises(ValueError, match="maxBins"):
        grid_search(df, bad, "id")


def test_model_is_saved_and_explained(planted, tmp_path):
    df, _, _ = planted
    model = SecondOrderTrees(maxDepth=2, maxIter=3, stepSize=0.3).fit(df)
    model.save(str(tmp_path / "model"))
    again = SecondOrderModel.load(str(tmp_path / "model"))
    assert again.trees == model.trees and again.getOrDefault(again.stepSize) == 0.3
    PipelineModel([model]).save(str(tmp_path / "pipeline"))
    whole = PipelineModel.load(str(tmp_path / "pipeline"))
    assert score(whole, df).select("id", "score").exceptAll(score(model, df).select("id", "score")).isEmpty()
    shares = {r["feature"]: r["importance"] for r in feature_importance(model, ["a", "b", "c"], df).collect()}
    assert math.isclose(sum(shares.values()), 1.0) and min(shares["a"], shares["b"]) > shares["c"]
    row = model.transform(df).first()
    assert math.isclose(row["probability"].sum(), 1.0) and row["prediction"] == float(row["probability"][1] > 0.5)
    assert model.transform(df).columns == ["id", "label", "features", "rawPrediction", "probability", "prediction"]


def test_ties_go_to_the_lower_feature_and_cut():
    g = np.array([-2.0, 0, 2, -2, 0, 2])
    found = best_splits(np.zeros(6, int), np.repeat([0, 1], 3), np.tile([0, 1, 2], 2), g, np.full(6, 2.0), [FitOptions()], lambda n: n)
    assert (found["feature"][0], found["cut"][0], found["missing"][0]) == (0, 1, 1)


def test_odd_tables(spark, planted):
    df, _, _ = planted
    trees = SecondOrderTrees(maxDepth=2, maxIter=2)
    one = df.where("label = 0")
    scores = score(trees.fit(one), one).agg(F.max("score")).first()[0]
    assert scores < 0.5
    constant = df.drop("features").crossJoin(df.where("id = 0").select("features"))
    model = trees.fit(constant)
    assert all(not tree["levels"] for tree in model.trees)
    nothing = trees.fit(df.limit(0))
    assert score(nothing, df).select("score").distinct().collect()[0][0] == 0.5
    with pytest.raises(Exception, match="label"):
        trees.fit(df.withColumn("label", F.lit(2)))


def test_boosted_fits_demand_a_checkpoint_folder(spark, monkeypatch):
    import oddsmith.session as session

    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda *a, **b: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.require_checkpoints(spark, SecondOrderTrees())


def test_no_python_in_the_plan(planted):
    df, _, _ = planted
    plan = SecondOrderTrees(maxDepth=2, maxIter=2).fit(df).transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan
