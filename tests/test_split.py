import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from oddsmith.functions import hash_bound, key_hash
from oddsmith.operators.cutoffs import (
    HASH,
    STRATUM,
    _passes,
    count_strata,
    hash_cutoffs,
    shared_out,
    with_stratum,
)
from oddsmith.operators.split import (
    DateSplit,
    anchor_windows,
    assign_folds,
    split_by_dates,
    split_random,
)


def test_date_splits_are_disjoint_and_complete(table):
    orders = table("orders")
    split = split_by_dates(orders, "o_orderdate", "2000-01-01", "2001-01-01")
    assert split.count() == orders.count()
    edges = {r["split"]: (r["lo"], r["hi"]) for r in split.groupBy("split").agg(
        F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")).collect()}
    assert edges["train"][1] < datetime(2000, 1, 1) <= edges["val"][0]
    assert edges["val"][1] < datetime(2001, 1, 1) <= edges["test"][0]


def _days(spark, kind):
    days = ["2020-01-01", "2020-01-02", "2020-01-03", "2020-01-04", None]
    return spark.createDataFrame([(d,) for d in days], "d string").select(
        F.col("d").cast(kind).alias("d"), F.col("d").alias("name")
    )


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_edges_and_missing_dates(spark, kind):
    split = split_by_dates(_days(spark, kind), "d", date(2020, 1, 2), date(2020, 1, 4))
    assert {r["name"]: r["split"] for r in split.collect()} == {
        "2020-01-01": "train",
        "2020-01-02": "val",
        "2020-01-03": "val",
        "2020-01-04": "test",
    }


def test_a_moment_within_a_day(spark):
    split = split_by_dates(_days(spark, "date"), "d", "2020-01-02 12:00:00", "2020-01-04")
    assert {r["name"] for r in split.filter("split = 'train'").collect()} == {
        "2020-01-01",
        "2020-01-02",
    }


def test_outer_dates_are_opt_in(spark):
    dates = dict(start="2020-01-02", end="2020-01-03")
    split = split_by_dates(_days(spark, "timestamp_ntz"), "d", "2020-01-03", "2020-01-03", **dates)
    assert {r["name"]: r["split"] for r in split.collect()} == {
        "2020-01-02": "train",
        "2020-01-03": "test",
    }


def test_overlapping_splits_raise():
    with pytest.raises(ValueError):
        DateSplit("d", "2020-02-01", "2020-01-01")


def test_a_split_column_must_be_a_date(spark):
    with pytest.raises(TypeError):
        split_by_dates(spark.range(1), "id", "2020-01-01", "2020-01-02")


def test_one_split_prunes_at_the_scan(table):
    dates = DateSplit("o_orderdate", "2000-01-01", "2001-01-01")
    plan = plan_of(dates.apply(table("orders"), "val").select("o_orderkey"))
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
    assert "o_totalprice" not in plan[plan.index("ReadSchema") :]
    assert "Exchange" not in plan


def test_anchor_windows():
    windows = anchor_windows("2022-10-30")
    assert (windows.start, windows.val_start) == (date(2022, 5, 3), date(2022, 8, 31))
    assert (windows.test_start, windows.end) == (date(2022, 9, 30), date(2022, 10, 29))


def test_hash_is_spread_and_repeatable(spark):
    hashed = spark.range(20_000).select("id", key_hash(["id"], 42).alias("h"))
    for share in (0.1, 0.5, 1 / 3):
        below = hashed.filter(F.col("h") < hash_bound(share)).count()
        assert abs(below / 20_000 - share) < 0.01
    assert hashed.select("h").distinct().count() == 20_000
    again = spark.range(20_000).repartition(3).select("id", key_hash(["id"], 42).alias("h"))
    assert hashed.exceptAll(again).count() == 0


def test_random_split_needs_no_shuffle(table):
    split = split_random(table("orders"), "o_orderkey", 0.25)
    assert "Exchange" not in plan_of(split)
    share = split.agg(F.avg((F.col("split") == "test").cast("double"))).first()[0]
    assert abs(share - 0.25) < 0.04


def test_missing_keys_stay_in(spark):
    frame = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    assert split_random(frame, "k").count() == 3


@pytest.mark.parametrize("test_size", [0.1, 0.25, 1 / 3])
def test_exact_size(spark, test_size):
    for n in (3, 30, 101):
        split = split_random(spark.range(n), "id", test_size, exact=True)
        assert split.columns == ["id", "split"]
        assert split.filter("split = 'test'").count() == math.ceil(test_size * n)
        assert split.count() == n


def test_exact_split_of_nothing(spark):
    assert split_random(spark.range(0), "id", exact=True).count() == 0


def test_stratified_shares(spark):
    frame = spark.range(1000).select(
        "id",
        F.expr("CASE WHEN id < 700 THEN 'a' WHEN id < 997 THEN 'b' END").alias("s"),
    )
    split = split_random(frame, "id", 0.25, stratify="s")
    tests = {r["s"]: r["count"] for r in split.filter("split = 'test'").groupBy("s").count().collect()}
    assert tests["a"] == 175 and tests["b"] in (74, 75) and tests.get(None, 0) in (0, 1)
    assert sum(tests.values()) == 250
    assert split.count() == 1000


def test_stratified_by_two_columns_leaves_the_table_unshuffled(spark, table):
    split = split_random(table("orders"), "o_orderkey", stratify=["o_orderstatus", "o_orderpriority"])
    plan = plan_of(split)
    own = plan.split("InMemoryRelation")[0]  # what follows made the cutoffs, which are kept
    assert "BroadcastHashJoin" in own and "hashpartitioning" not in own
    assert split.count() == table("orders").count()


def test_shares_add_up(spark):
    for rows in ([3, 3, 3], [1, 1, 8], [5], [7, 11, 13, 17], [1] * 50, [2] * 31 + [3]):
        frame = spark.createDataFrame([(i,) for i, n in enumerate(rows) for _ in range(n)], "s int")
        strata = count_strata(with_stratum(frame, ["s"]))
        shares = {r[STRATUM]["s"]: r["_rank"] for r in shared_out(strata, ["s"], 0.25).collect()}
        assert sum(shares.values()) == math.ceil(0.25 * sum(rows))
        assert all(abs(shares[i] - 0.25 * n) <= 1 for i, n in enumerate(rows))


def test_more_strata_than_a_driver_should_hold(spark):
    frame = spark.range(240_000).select("id", (F.col("id") % 120_000).alias("s"))
    split = split_random(frame, "id", 0.25, stratify="s")
    tests = split.filter("split = 'test'")
    assert tests.count() == 60_000 and split.count() == 240_000
    assert tests.groupBy("s").count().filter("count > 1").count() == 0


def test_parts_of_a_key_are_told_apart(spark):
    rows = [("a:b", "c"), ("a", "b:c"), ("x", None), ("x", ""), ("1:x", "y"), ("1", "x:y")]
    frame = spark.createDataFrame(rows, "a string, b string")
    assert frame.select(key_hash(["a", "b"], 1)).distinct().count() == 6
    for seed in range(5):
        split = split_random(frame.limit(4), ["a", "b"], 0.25, seed, exact=True)
        assert split.filter("split = 'test'").count() == 1


def test_cutoffs_of_a_large_table_equal_those_of_a_small_one(spark):
    hashed = spark.range(5000).select(
        F.struct((F.col("id") % 3).alias("s")).alias(STRATUM), key_hash(["id"], 1).alias(HASH)
    )
    ranks = [[0, 1, 500], [10, 1000, 1667], [400, 800, 1200]]
    rows = [(s, at, rank) for s, of in enumerate(ranks) for at, rank in enumerate(of)]
    wanted = spark.createDataFrame(rows, "s long, _at int, _rank long").select(
        F.struct("s").alias(STRATUM), "_at", "_rank"
    )
    by_stratum = [
        sorted(r[HASH] for r in hashed.filter(f"{STRATUM}.s = {s}").collect()) for s in range(3)
    ]
    brute = {(s, at, of[k - 1] if k else "") for s, of in enumerate(by_stratum) for at, k in enumerate(ranks[s])}
    for small in (0, 2_000, 1 << 20):
        found = hash_cutoffs(hashed, wanted, 1667, small=small).collect()
        assert {(r[STRATUM]["s"], r["_at"], r["_edge"]) for r in found} == brute


def test_passes_grow_with_the_table():
    assert _passes(10**6, 1 << 20) == [32]
    assert _passes(10**10, 1 << 20) == [4, 32]
    assert _passes(10**13, 1 << 20) == [4, 8, 32]


def test_a_hot_key_keeps_its_rows_together(spark):
    frame = spark.range(900).select(F.expr("IF(id < 300, 0, id)").alias("k"))
    for small in (True, False):
        split = split_random(frame, "k", 0.5, exact=small)
        sides = split.groupBy("k").agg(F.countDistinct("split").alias("sides"))
        assert sides.filter("sides > 1").count() == 0
        assert split.count() == 900


def test_folds(spark):
    frame = spark.range(103).select("id", (F.col("id") % 10 == 0).alias("y"))
    folds = assign_folds(frame, "id", 4, stratify="y")
    sizes = folds.groupBy("y", "fold").count().collect()
    for outcome in (True, False):
        counts = [r["count"] for r in sizes if r["y"] is outcome]
        assert len(counts) == 4 and max(counts) - min(counts) <= 1
    plain = assign_folds(frame, "id", 4)
    assert "Exchange" not in plan_of(plain)
    assert {r["fold"] for r in plain.select("fold").distinct().collect()} == {0, 1, 2, 3}
