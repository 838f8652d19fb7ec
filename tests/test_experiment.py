import re
import time

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import functions as F

from oddsmith.operators.evaluate import roc_auc
from oddsmith.operators.features import feature_names
from oddsmith.operators.models import PenalizedLogit, boosted_trees, random_forest, score
from oddsmith.operators.search import Search, logistic_search
from oddsmith.operators.split import DateSplit
from oddsmith.plans import (
    ExperimentData,
    append_run_log,
    best_run,
    prepare,
    run_experiment,
)
from oddsmith.plans import presets
from oddsmith.plans.experiment import fit_on
from oddsmith.plans.runlog import RUN_LOG_SCHEMA
from oddsmith.session import ensure_checkpoint_dir
from oddsmith.sources import read_table
from oddsmith.sources.small import small_frame
from oddsmith.streaming import append_scores, score_stream


@pytest.fixture(scope="module")
def leads(spark):
    """3,000 leads over 200 days before the anchor; the outcome follows ``f1`` and gender."""
    return spark.range(3000).select(
        F.col("id").alias("lead_id"),
        F.expr("date_sub(DATE'2022-10-30', CAST(id % 200 AS INT))").alias("create_date"),
        F.expr("CAST(hash(id) % 100 > IF(id % 2 = 0, 30, -30) AS INT)").alias("target"),
        F.expr("IF(id % 9 = 0, NULL, (hash(id) % 100) / 100D)").alias("f1"),
        F.expr("IF(id % 8 = 0, NULL, CAST(id % 5 AS INT))").alias("i1"),
        F.expr("IF(id % 7 = 0, NULL, id % 3 = 0)").alias("b1"),
        F.expr("IF(id % 2 = 0, 'M', IF(id % 10 = 1, NULL, 'F'))").alias("individual_gender"),
        F.expr("element_at(array('Chrome', 'Facebook', 'Safari', 'Edge'), CAST(id % 4 AS INT) + 1)")
        .alias("direct_lead_browser"),
        F.expr("IF(id % 6 = 0, 'one.example', 'elsewhere.example')").alias("direct_lead_domain"),
        F.expr("IF(id % 3 = 0, 'exact match', IF(id % 3 = 1, 'close match', NULL))")
        .alias("ebureau_verify_email"),
    ).cache()


KEPT = {
    "individual_gender": ("M", "F"),
    "direct_lead_browser": ("Chrome", "Facebook", "Webview/iOS"),
    "direct_lead_domain": ("one.example", "two.example"),
}
CODED = {"ebureau_verify_email": ({"exact match": 0, "close match": 1}, 2)}
NAMES = (["f1"], ["i1"], ["b1"])
STRINGS = [*KEPT, *CODED]


@pytest.fixture(scope="module")
def prepared(leads):
    data = presets.lead_data(leads, *NAMES, STRINGS)
    return prepare(data, presets.lead_encoder(*NAMES, KEPT, CODED))


def test_preset_features(prepared):
    assert prepared.names == [
        "f1",
        "i1",
        "b1",
        "individual_gender_F",
        "individual_gender_M",
        "individual_gender_other",
        "direct_lead_browser_Chrome",
        "direct_lead_browser_Facebook",
        "direct_lead_browser_other",
        "direct_lead_domain_other",
        "ebureau_verify_email_0",
        "ebureau_verify_email_1",
        "ebureau_verify_email_2",
    ]


def test_preset_estimators(spark):
    found = presets.lead_estimators()
    trees = found["boosted-trees"]
    assert (trees.getMaxDepth(), trees.getStepSize(), trees.getSeed()) == (3, 0.05, 422)
    assert [len(s.grid) for s in found.values() if isinstance(s, Search)] == [128, 126, 14]


def test_data(prepared):
    data = prepared.data
    assert data.check_key().first()["is_primary_key"]
    shapes = {r["split"]: r["n_rows"] for r in data.shapes().collect()}
    assert shapes == {"train": 139 * 15, "val": 30 * 15, "test": 31 * 15}
    shares = data.target_shares().groupBy("split").agg(F.sum("fraction").alias("f")).collect()
    assert all(abs(r["f"] - 1) < 1e-12 for r in shares)


def test_target_must_be_an_outcome(leads):
    broken = leads.withColumn("target", F.expr("IF(lead_id = 7, NULL, target)"))
    data = presets.lead_data(broken, *NAMES, STRINGS)
    with pytest.raises(Exception, match="target is neither 0 nor 1"):
        data.rows().collect()


def test_run_on_train_and_val(prepared, leads):
    run = run_experiment(
        prepared, boosted_trees(n_trees=5), baseline_auc=0.75, description="first", experiment_id=9
    )
    assert set(run.aucs) == {"train", "val"}
    assert run.aucs["train"] > 0.85 and run.aucs["val"] > 0.8
    rows = {r["split"]: r for r in run.metrics.collect()}
    assert abs(rows["val"]["lift"] - (run.aucs["val"] - 0.75)) < 1e-12
    assert run.importances.first()["feature"] == "f1"
    log = run.log.collect()
    metrics = {r["key"]: r["value_num"] for r in log if r["kind"] == "metric"}
    assert metrics == {
        "BaselineAUC": 0.75,
        "TrainAUC": run.aucs["train"],
        "ValAUC": run.aucs["val"],
    }
    tags = {r["key"]: r["value"] for r in log if r["kind"] == "tag"}
    assert tags["description"] == "first" and tags["feature_names"].startswith("b1, f1, i1, ")
    assert {r["key"] for r in log if r["kind"] == "importance"} == set(prepared.names)
    assert {r["value"] for r in log if r["key"] == "maxIter"} == {"5"}
    assert re.fullmatch(r"225\d{9}", log[0]["run_name"])
    # The whole pipeline takes raw rows.
    val = prepared.data.rows("val")
    assert roc_auc(score(run.model, val), "label", "score").first()["auc"] == run.aucs["val"]


def test_test_auc_has_its_own_key(prepared):
    run = run_experiment(prepared, PenalizedLogit(), splits=("train", "val", "test"))
    keys = [r["key"] for r in run.log.filter("kind = 'metric'").collect()]
    assert sorted(keys) == ["BaselineAUC", "TestAUC", "TrainAUC", "ValAUC"]
    assert run.importances.count() == 0
    points = run.roc().filter("split = 'test'").agg(F.max("tpr"), F.max("fpr")).first()
    assert tuple(points) == (1.0, 1.0)


def test_search_in_a_run(prepared):
    run = run_experiment(prepared, logistic_search(strengths=(0.1,), penalties=("l2",), folds=2))
    assert run.aucs["val"] > 0.8 and len(run.fitted.avgMetrics) == 1


def test_encoder_refitted_for_each_fold(prepared):
    encoder = presets.lead_encoder(*NAMES, KEPT, CODED)
    logit = PenalizedLogit()
    search = Search(Pipeline(stages=[encoder, logit]), [{logit.C: 0.1}], folds=2)
    found = search.fit(prepared.data.rows("train").drop("split"), "lead_id")
    assert found.avgMetrics[0] > 0.8
    assert feature_names(found.bestModel) == prepared.names


def test_any_encoder_with_names(prepared):
    encoder = Pipeline(stages=[Imputer(inputCols=["f1"], outputCols=["f1_filled"]),
                               VectorAssembler(inputCols=["f1_filled"], outputCol="features")])
    own = prepare(prepared.data, encoder, names=lambda model: ["filled"])
    run = run_experiment(own, random_forest(n_trees=3))
    assert [tuple(r) for r in run.importances.collect()] == [("filled", 1.0)]
    assert prepare(prepared.data, encoder).names == ["f1_filled"]


def test_log_table_and_best_run(spark, prepared):
    spark.sql("CREATE DATABASE IF NOT EXISTS runs")
    found = presets.lead_runs(
        prepared, {"forest": random_forest(n_trees=2, max_depth=1), "logit": PenalizedLogit()}
    )
    assert all(run.run.experiment_id == 422 for run in found.values())
    for run in found.values():
        append_run_log(run.log, "log", "runs")
    log = read_table(spark, "log", "runs")
    assert log.select("run_id").distinct().count() == 2
    assert log.count() == sum(run.log.count() for run in found.values())
    winner = max(found.values(), key=lambda run: run.aucs["val"])
    best = best_run(log).first()
    assert best["run_id"] == winner.run.run_id and best["value"] == winner.aucs["val"]


def test_an_append_tried_again_leaves_one_run(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS runs")

    def rows(run, experiment):
        return small_frame(spark, [(run, run, experiment, "metric", "ValAUC", None, 0.7, 0.0), (run, run, experiment, "tag", "a", "b", None, 0.0)], RUN_LOG_SCHEMA)

    for run, experiment in (("a", 1), ("a", 1), ("b", 1), ("a", 2), ("b", 1)):
        append_run_log(rows(run, experiment), "again", "runs")
    log = read_table(spark, "again", "runs")
    assert sorted((r["experiment_id"], r["run_id"]) for r in log.collect()) == sorted([(1, "a"), (1, "b"), (2, "a")] * 2)
    assert log.columns[-1] == "experiment_id" and best_run(log).count() == 2


def test_best_run_ties_and_gaps(spark):
    rows = [
        ("b", "b", 1, "metric", "ValAUC", None, 0.7, 0.0),
        ("a", "a", 1, "metric", "ValAUC", None, 0.7, 0.0),
        ("c", "c", 1, "metric", "ValAUC", None, None, 0.0),
        ("d", "d", 1, "metric", "TrainAUC", None, 0.9, 0.0),
        ("e", "e", 2, "param", "ValAUC", "x", None, 0.0),
    ]
    found = best_run(small_frame(spark, rows, RUN_LOG_SCHEMA)).collect()
    assert [tuple(r) for r in found] == [(1, "a", "a", 0.7)]


def test_boosted_trees_demand_a_checkpoint_folder(spark, monkeypatch):
    import oddsmith.session as session

    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda *a, **b: None)
    session.require_checkpoints(spark, PenalizedLogit())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.require_checkpoints(spark, Pipeline(stages=[boosted_trees()]))


def test_equal_partitions_give_equal_forests(prepared):
    """Whatever the rows' placement was before."""
    rows = prepared.train_rows().cache()
    forest = random_forest(n_trees=3, featureSubsetStrategy="sqrt")
    models = [fit_on(df, forest, "lead_id", partitions=5) for df in (rows, rows.repartition(3), rows.repartition(11, "label"))]
    assert len({m.toDebugString.split(chr(10), 1)[1] for m in models}) == 1


def test_checkpoint_dir_is_the_sessions(spark):
    assert ensure_checkpoint_dir(spark).startswith(
        "file:" + spark.conf.get("spark.checkpoint.dir")
    ) or spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)


def test_stream_scores_equal_batch_scores(spark, prepared, tmp_path):
    run = run_experiment(prepared, PenalizedLogit())
    raw = prepared.data.rows()
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    query = append_scores(
        score_stream(run.model, stream), str(tmp_path / "out"), str(tmp_path / "state")
    )
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out")).select("lead_id", "score")
    batch = score(run.model, raw).select("lead_id", "score")
    assert streamed.count() == 3000
    assert streamed.exceptAll(batch).count() == 0
    with pytest.raises(ValueError):
        score_stream(run.model, raw)


def test_splits_work_on_streams(spark, prepared, tmp_path):
    from oddsmith.operators.split import split_random

    raw = prepared.data.df.select("lead_id", "create_date")
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    both = split_random(prepared.data.dates.apply(stream), "lead_id", split="side")
    query = append_scores(both, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    expected = split_random(prepared.data.dates.apply(raw), "lead_id", split="side")
    assert streamed.exceptAll(expected).count() == 0 and streamed.count() == 3000


def test_a_stopped_stream_goes_on_where_it_was(spark, prepared, tmp_path):
    from oddsmith.operators.features import FeatureEncoder, MeanImpute
    from oddsmith.operators.schema import shorten_columns
    from oddsmith.operators.split import split_random

    raw = prepared.data.df.select("lead_id", "create_date", "f1")
    raw = raw.toDF(*(f"view.{name}" for name in raw.columns))
    raw.repartition(6).write.parquet(str(tmp_path / "in"))
    encoder = FeatureEncoder([MeanImpute(["f1"])]).fit(shorten_columns(raw))

    def steps(rows):
        return encoder.transform(split_random(prepared.data.dates.apply(shorten_columns(rows)), "lead_id", split="side"))

    def start(now):
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return append_scores(steps(stream), str(tmp_path / "out"), str(tmp_path / "state"), available_now=now)

    query = start(False)
    while not query.recentProgress or query.recentProgress[-1]["numInputRows"] == 0:
        assert query.exception() is None
        time.sleep(0.05)
    query.stop()
    before = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < before < raw.count()
    query = start(True)
    assert query.awaitTermination(120)
    expected = steps(raw)
    streamed = spark.read.parquet(str(tmp_path / "out")).select(expected.columns)
    assert streamed.count() == raw.count()
    assert streamed.select("lead_id").distinct().count() == raw.count()
    drop = [name for name, kind in expected.dtypes if kind == "vector"]
    assert streamed.drop(*drop).exceptAll(expected.drop(*drop)).count() == 0


def test_data_needs_its_columns(leads):
    with pytest.raises(ValueError, match="no such column"):
        presets.lead_data(leads, ["nope"], ["i1"], ["b1"], STRINGS)
    dates = DateSplit("create_date", "2022-09-01", "2022-10-01")
    data = ExperimentData(leads, "target", ["f1"], "lead_id", dates)
    assert data.rows().columns == ["lead_id", "split", "label", "f1"]
