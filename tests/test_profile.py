import hashlib
import math

import pytest
from pyspark.sql import functions as F

from oddsmith.operators.profile import POISSON_BOUNDS, mean_by, mean_intervals, outcome_rate, split_shapes, target_distribution


@pytest.fixture(scope="module")
def leads(spark):
    rows = [("F", True), ("F", False), ("F", None), ("M", None), (None, True), (None, True)]
    return spark.createDataFrame(rows, "gender string, app_started boolean")


def test_rates(leads):
    found = outcome_rate(leads)
    assert found.columns == ["gender", "n", "n_app_started", "p_app_started"]
    assert {r["gender"]: tuple(r)[1:] for r in found.collect()} == {
        "F": (2, 1, 0.5),
        "M": (0, 0, None),
        None: (2, 2, 1.0),
    }


def test_order(leads):
    assert [r["p_app_started"] for r in outcome_rate(leads, order="p").collect()] == [None, 0.5, 1]
    assert [r["gender"] for r in outcome_rate(leads, order="gender").collect()] == [None, "F", "M"]
    assert [r["n"] for r in outcome_rate(leads).collect()] == [0, 2, 2]


def test_rounding_is_half_up(spark):
    frame = spark.range(320).select(F.lit("a").alias("g"), (F.col("id") < 23).alias("c"))
    assert outcome_rate(frame, "g", "c").first()["p_c"] == 0.07188
    assert outcome_rate(frame, "g", "c", digits=None).first()["p_c"] == 23 / 320


def test_expression_criterion_needs_a_name(leads):
    with pytest.raises(ValueError):
        outcome_rate(leads, "gender", F.col("gender") == "F")


def test_criterion_may_be_called_like_the_column(spark):
    frame = spark.createDataFrame([(True,), (False,), (True,)], "flag boolean")
    assert {tuple(r) for r in outcome_rate(frame, "flag", "flag").collect()} == {
        (True, 2, 2, 1.0),
        (False, 1, 0, 0.0),
    }


def test_means(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "x string, y double")
    assert [tuple(r) for r in mean_by(frame, "x", "y").collect()] == [("a", 2.0, 2), ("b", None, 0)]


def test_distribution_leaves_out_missing_targets(spark):
    rows = [("train", 1), ("train", 0), ("train", 0), ("train", None), ("val", 1)]
    frame = spark.createDataFrame(rows, "split string, label int")
    assert [tuple(r) for r in target_distribution(frame, "label").collect()] == [
        ("train", 0, 2, 2 / 3),
        ("train", 1, 1, 1 / 3),
        ("val", 1, 1, 1.0),
    ]
    assert [tuple(r) for r in split_shapes(frame, 3).collect()] == [
        ("train", 4, 3, 1),
        ("val", 1, 3, 1),
    ]


def _weight(seed, key, replicate):
    text = hashlib.md5(f"{seed}:{replicate // 4}:{'' if key is None else key}".encode()).hexdigest()
    bits = int(text[replicate % 4 * 8 :][:8], 16)
    return sum(bits >= bound for bound in POISSON_BOUNDS)


@pytest.mark.parametrize("replicates, level, seed", [(100, 0.95, 0), (9, 0.5, 3), (1, 0.9, 0)])
def test_intervals_are_those_of_plain_replicates(spark, replicates, level, seed):
    rows = [(i, "ab"[i % 3 // 2], float(i * i % 17)) for i in range(60)]
    rows += [(None, "a", 4.0), (61, None, 2.0), (62, None, 5.0), (63, "a", None), (64, "none", None)]
    frame = spark.createDataFrame(rows, "id long, x string, y double").repartition(5)
    found = mean_intervals(frame, "x", "y", "id", replicates=replicates, level=level, seed=seed)
    assert found.columns == ["x", "mean_y", "n", "low_y", "high_y"]
    found = {r["x"]: tuple(r)[1:] for r in found.collect()}
    assert set(found) == {"a", "b", None, "none"}
    assert found["none"] == (None, 0, None, None)
    for x in ("a", "b", None):
        mine = [(key, y) for key, z, y in rows if z == x and y is not None]
        means = []
        for r in range(replicates):
            weights = [_weight(seed, key, r) for key, _ in mine]
            if sum(weights):
                means.append(sum(w * y for w, (_, y) in zip(weights, mine)) / sum(weights))
        means.sort()
        ends = [None, None]
        if means:
            ranks = (math.ceil(round(share * len(means), 9)) for share in ((1 - level) / 2, (1 + level) / 2))
            ends = [means[max(rank, 1) - 1] for rank in ranks]
        expected = (sum(y for _, y in mine) / len(mine), len(mine), *ends)
        assert found[x] == pytest.approx(expected)


def test_intervals_are_as_wide_as_the_normal_ones(spark):
    frame = spark.range(4000).select("id", F.lit("a").alias("x"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    row = mean_intervals(frame, "x", "y", "id", replicates=200).first()
    assert row["low_y"] < 0.3 < row["high_y"]
    assert row["high_y"] - row["low_y"] == pytest.approx(2 * 1.96 * math.sqrt(0.3 * 0.7 / 4000), rel=0.25)


def test_intervals_want_replicates_and_a_level(spark):
    frame = spark.range(1).withColumn("y", F.lit(1))
    for options in ({"replicates": 0}, {"level": 1.0}):
        with pytest.raises(ValueError):
            mean_intervals(frame, "id", "y", "id", **options)
