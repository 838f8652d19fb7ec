import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import plan_of
from oddsmith.operators.evaluate import (
    RocAuc,
    compare_with_baseline,
    explained_variance,
    roc_auc,
    roc_points,
    roc_vertices,
    score_bounds,
)


def pairs_won(rows):
    """AUC by its meaning: the share of (positive, negative) pairs in right order."""
    positives = [s for y, s in rows if y]
    negatives = [s for y, s in rows if not y]
    if not positives or not negatives:
        return None
    won = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(positives, negatives))
    return won / (len(positives) * len(negatives))


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, s double")


def auc_of(frame, **options):
    return roc_auc(frame, "y", "s", **options).first()["auc"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.integers(0, 1), st.sampled_from([-math.inf, -1.5, -0.0, 0.0, 0.5, 2.0, 7.0])),
        min_size=1,
        max_size=40,
    ),
    st.sampled_from([1, 3, 1000]),
)
def test_auc_equals_counting_pairs(spark, rows, rows_per_bucket):
    found = auc_of(scored(spark, rows), rows_per_bucket=rows_per_bucket)
    expected = pairs_won(rows)
    assert found == expected or math.isclose(found, expected, rel_tol=1e-12)


@pytest.fixture(scope="module")
def lines(table):
    return table("lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.expr("l_extendedprice + 100 * l_quantity").alias("s"),
        "l_linestatus",
    )


def test_buckets_do_not_change_the_result(lines):
    results = {tuple(roc_auc(lines, "y", "s", rows_per_bucket=n).first()) for n in (10, 500, 10**9)}
    assert len(results) == 1
    spark_auc = BinaryClassificationEvaluator(
        labelCol="y", rawPredictionCol="s", numBins=0
    ).evaluate(lines.withColumn("y", F.col("y").cast("double")))
    assert math.isclose(results.pop()[2], spark_auc, rel_tol=1e-9)


def test_bounds_are_even(spark):
    frame = spark.range(100_000).select((F.col("id") * 1.0).alias("s"))
    bounds = score_bounds(frame, 5_000)
    sizes = np.diff([0, *bounds, 100_000])
    assert len(sizes) == 20 and sizes.max() < 4 * sizes.min()


def test_a_hot_score_makes_no_hot_bucket(spark):
    # A third of the rows share one score.
    frame = spark.range(30_000).select(
        (F.col("id") % 2).cast("int").alias("y"),
        F.expr("IF(id % 3 = 0, 0.5D, id / 30000D)").alias("s"),
    )
    bounds = score_bounds(frame.select("s"), 1_000)
    assert len(set(bounds)) == len(bounds) > 15
    assert auc_of(frame, rows_per_bucket=1_000) == auc_of(frame, rows_per_bucket=10**9)


def test_scores_fold_before_the_first_shuffle(lines):
    plan = plan_of(roc_auc(lines, "y", "s", rows_per_bucket=500))
    scan_to_shuffle = plan[plan.rindex("Exchange") :]
    assert "partial_sum" in scan_to_shuffle
    # One task sees bucket totals only: below their aggregation all is spread.
    assert "SinglePartition" not in plan[plan.rindex("shiftright") :]
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_points_move_once_more_after_counting(spark, lines):
    """Where bucket totals are too many to broadcast, they come to the points."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = roc_points(lines, "y", "s", "l_linestatus", rows_per_bucket=400)
        plan = plan_of(points)
        assert "SortMergeJoin" in plan
        # Points: by score, by bucket. Totals: by bucket, by group, to the join.
        assert plan.count("Exchange hashpartitioning") == 5
        joined = points.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined == roc_points(lines, "y", "s", "l_linestatus").count()


def test_groups(spark, lines):
    together = {
        r["l_linestatus"]: r["auc"]
        for r in roc_auc(lines, "y", "s", "l_linestatus", rows_per_bucket=400).collect()
    }
    for status, auc in together.items():
        assert auc == auc_of(lines.filter(F.col("l_linestatus") == status))


def test_missing_group_is_a_group(spark):
    rows = [(1, 0.9, None), (0, 0.1, None), (1, 0.1, "a"), (0, 0.9, "a")]
    frame = spark.createDataFrame(rows, "y int, s double, g string")
    found = roc_auc(frame, "y", "s", "g", rows_per_bucket=1).collect()
    assert {r["g"]: r["auc"] for r in found} == {None: 1.0, "a": 0.0}
    points = roc_points(frame, "y", "s", "g", rows_per_bucket=1)
    assert points.count() == 4


def test_one_outcome_only(spark):
    assert auc_of(scored(spark, [(1, 0.1), (1, 0.2)])) is None
    assert [tuple(r) for r in roc_points(scored(spark, [(1, 0.1)]), "y", "s").collect()] == [
        (0.1, 1, 0, 1.0, None)
    ]


@pytest.mark.parametrize("row", [(None, 0.5), (2, 0.5), (1, None), (1, float("nan"))])
def test_bad_rows_fail(spark, row):
    with pytest.raises(Exception, match="missing score|neither 0 nor 1"):
        roc_auc(scored(spark, [(1, 0.2), row]), "y", "s").collect()


def test_boolean_labels(spark):
    frame = scored(spark, [(1, 0.9), (0, 0.2)]).withColumn("y", F.col("y") == 1)
    assert auc_of(frame) == 1.0


@pytest.mark.parametrize("rows_per_bucket", [2, 10**6])
def test_roc_points_by_brute_force(spark, rows_per_bucket):
    rows = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.5), (0, 0.5), (1, 0.1), (0, -2.0)]
    found = roc_points(
        scored(spark, rows), "y", "s", origin=True, rows_per_bucket=rows_per_bucket
    )
    expected = {(math.inf, 0, 0)}
    for threshold in {s for _, s in rows}:
        above = [y for y, s in rows if s >= threshold]
        expected.add((threshold, sum(above), len(above) - sum(above)))
    assert {tuple(r)[:3] for r in found.collect()} == expected
    assert all(r["tpr"] == r["tp"] / 3 and r["fpr"] == r["fp"] / 4 for r in found.collect())


def test_trapezoids_under_the_points_are_the_auc(lines):
    points = roc_points(lines, "y", "s", origin=True, rows_per_bucket=300).toPandas()
    points = points.sort_values("threshold", ascending=False)
    area = np.trapezoid(points.tpr, points.fpr)
    assert math.isclose(area, auc_of(lines), rel_tol=1e-9)


def test_explained_variance(spark):
    frame = spark.createDataFrame(
        [("a", 3.0, 2.5), ("a", -0.5, 0.0), ("a", 2.0, 2.0), ("a", 7.0, 8.0)]
        + [("flat", 1.0, 3.0), ("flat", 1.0, 3.0), ("wrong", 1.0, 3.0), ("wrong", 1.0, 2.0)],
        "g string, y double, p double",
    )
    found = dict(tuple(r) for r in explained_variance(frame, "y", "p", "g").collect())
    actual, predicted = np.array([3, -0.5, 2, 7]), np.array([2.5, 0, 2, 8])
    assert math.isclose(found["a"], 1 - np.var(actual - predicted) / np.var(actual))
    assert (found["flat"], found["wrong"]) == (1.0, 0.0)


def test_baseline(spark):
    frame = spark.createDataFrame([("val", 0.8), ("test", None)], "split string, auc double")
    rows = {r["split"]: r for r in compare_with_baseline(frame, 0.75).collect()}
    assert rows["val"]["baseline_auc"] == 0.75 and math.isclose(rows["val"]["lift"], 0.05)
    assert rows["test"]["lift"] is None


def test_evaluator(spark, tmp_path):
    assert RocAuc().isLargerBetter()
    RocAuc("y").save(str(tmp_path / "auc"))
    assert RocAuc.load(str(tmp_path / "auc")).getOrDefault("label") == "y"
    one = spark.createDataFrame([(1, Vectors.dense([0.2, 0.8]))], ["y", "probability"])
    assert math.isnan(RocAuc("y").evaluate(one))


def test_weighted_rows_count_as_many(spark):
    rows = [(1, 0.9, 2), (0, 0.9, 3), (1, 0.4, 1), (0, 0.1, 4)]
    weighted = spark.createDataFrame(rows, "y int, s double, n long")
    plain = weighted.selectExpr("y", "s", "explode(sequence(1L, n)) AS k")
    assert roc_auc(weighted, "y", "s", weight="n").collect() == roc_auc(plain, "y", "s").collect()
    a, b = (roc_points(f, "y", "s", weight=w) for f, w in ((weighted, "n"), (plain, None)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def _corners(rows):
    """Corners of a curve by walking it."""
    points, tp, fp = [(math.inf, 0, 0)], 0, 0
    for value in sorted({s for _, s in rows}, reverse=True):
        tp += sum(y for y, s in rows if s == value)
        fp += sum(1 - y for y, s in rows if s == value)
        points.append((value, tp, fp))
    inner = [
        b for a, b, c in zip(points, points[1:], points[2:])
        if (b[1] - a[1]) * (c[2] - b[2]) != (c[1] - b[1]) * (b[2] - a[2])
    ]
    return [points[0], *inner, points[-1]]


def _area(points):
    points = sorted(points, key=lambda x: (x[1], x[2]))
    return sum((b[2] - a[2]) * (b[1] + a[1]) / 2 for a, b in zip(points, points[1:]))


@pytest.mark.parametrize("rows_per_bucket", [1, 7, 10**6])
def test_vertices_are_those_of_a_walk(spark, rows_per_bucket):
    draw = np.random.default_rng(5)
    rows = [(int(y), float(s)) for y, s in zip(draw.integers(0, 2, 80), draw.integers(0, 30, 80))]
    rows += [(i % 2, 100.0 + i // 4) for i in range(40)]  # a straight run over many buckets
    frame = spark.createDataFrame([(y, s, g) for y, s in rows for g in (None, "g")], "y int, s double, g string")
    found = roc_vertices(frame, "y", "s", "g", rows_per_bucket=rows_per_bucket).collect()
    pos, neg = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    for g in (None, "g"):
        mine = sorted((tuple(r)[1:4] for r in found if r["g"] == g), key=lambda x: (x[1], x[2]))
        assert mine == _corners(rows)
        assert _area(mine) / (pos * neg) == pytest.approx(pairs_won(rows))
    assert len(found) < 2 * (len({s for _, s in rows}) - 8)


def test_bounded_curves_keep_their_area(spark):
    draw = np.random.default_rng(6)
    scores = draw.normal(size=3000)
    rows = [(int(draw.random() < 1 / (1 + math.exp(-s))), float(s)) for s in scores]
    frame = scored(spark, rows)
    pos, exact = sum(y for y, _ in rows), auc_of(frame)
    for most in (3, 20, 101):
        points = [tuple(r)[:3] for r in roc_vertices(frame, "y", "s", most=most, rows_per_bucket=100).collect()]
        assert len(points) <= most
        assert abs(_area(points) / (pos * (len(rows) - pos)) - exact) <= 1 / (2 * ((most - 1) // 2))
    with pytest.raises(ValueError):
        roc_vertices(frame, "y", "s", most=2)


def test_vertices_of_odd_tables(spark):
    frame = spark.createDataFrame([], "y int, s double")
    assert roc_vertices(frame, "y", "s").count() == 0
    ones = scored(spark, [(1, 0.5), (1, 0.7), (1, 0.9)])
    for most in (None, 5):
        found = sorted(tuple(r)[1:] for r in roc_vertices(ones, "y", "s", most=most).collect())
        assert found == [(0, 0, 0.0, None), (3, 0, 1.0, None)]
    weighted = spark.createDataFrame([(1, 0.9, 2), (0, 0.8, 0), (1, 0.7, 2), (0, 0.5, 4)], "y int, s double, w int")
    found = sorted(tuple(r)[1:3] for r in roc_vertices(weighted, "y", "s", weight="w").collect())
    assert found == [(0, 0), (4, 0), (4, 4)]
