"""Every registered query against its SQL in DuckDB, by names, rows and values."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as registry
from conftest import TESTDATA, plan_of

@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{TESTDATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _key(row):
    return [(value is not None, str(value)) for value in row]


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


# Queries of other packages have tests of their own.
OWN = sorted(n for n in registry.queries() if n != "pipeline" and not n.startswith("op"))


def test_every_query_is_checked():
    assert set(OWN) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, TESTDATA)
    plan = plan_of(frame)
    for slow in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert slow not in plan
    columns = sorted(frame.columns)
    mine = sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=_key)
    result = duck.execute(registry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    theirs = [tuple(row[names.index(c)] for c in sorted(names)) for row in result.fetchall()]
    theirs.sort(key=_key)
    assert columns == sorted(names)
    assert len(mine) == len(theirs)
    for left, right in zip(mine, theirs):
        assert all(_same(a, b) for a, b in zip(left, right)), (left, right)


def test_entry(spark):
    assert registry.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["experiment_train_val", "feature_importance", "experiment_roc", "repeated_experiments"])
def test_queries_fit_as_many_trees_as_the_worked_experiment(spark, monkeypatch, name):
    counts = []

    class Stop(Exception):
        pass

    def stop(*args, **options):
        raise Stop

    def recorded(make):
        return lambda **options: (counts.append(options["n_trees"]), make(**options))[1]

    for made in ("boosted_trees", "random_forest"):
        monkeypatch.setattr(registry, made, recorded(getattr(registry, made)))
    for fit in ("run_experiment", "run_experiments", "fit_on"):
        monkeypatch.setattr(registry, fit, stop)
    with pytest.raises(Stop):
        registry.queries()[name](spark, TESTDATA)
    assert counts and set(counts) == {100}


@pytest.mark.parametrize("name", ["grid_search_forest"])
def test_searches_tell_that_their_tree_counts_are_not_declared(name):
    assert "lie outside" in " ".join(registry.queries()[name].__doc__.split())
