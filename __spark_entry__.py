"""

Every query runs over its whole tables.
"""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.operators.boosting import SecondOrderTrees
from oddsmith.operators.evaluate import (
    compare_with_baseline,
    explained_variance,
    roc_auc,
    roc_points,
    roc_vertices,
)
from oddsmith.operators.features import (
    Categories,
    CodeMap,
    FeatureEncoder,
    KeepList,
    MeanImpute,
    PositiveFlag,
    TrueFlag,
    feature_names,
)
from oddsmith.functions import code_of, flag_positive, flag_true, keep_listed
from oddsmith.operators.keys import primary_key_check
from oddsmith.operators.models import (
    LABEL,
    PenalizedLogit,
    boosted_trees,
    feature_importance,
    model_params,
    random_forest,
    score,
)
from oddsmith.operators.profile import (
    POISSON_BOUNDS, mean_by, mean_intervals, outcome_rate, split_shapes, target_distribution,
)
from oddsmith.operators.regression import LinearFit
from oddsmith.operators.schema import check_roles, project_roles, shorten_columns
from oddsmith.operators.search import (
    boosted_tree_search,
    boosted_tree_search_short,
    logistic_search,
    random_forest_search,
    search_results,
)
from oddsmith.operators.split import (
    DateSplit,
    anchor_windows,
    assign_folds,
    split_by_dates,
    split_random,
)
from oddsmith.plans.experiment import (
    ExperimentData,
    PreparedData,
    fit_on,
    prepare,
    run_experiment,
    run_experiments,
)
from oddsmith.plans.runlog import (
    SPLIT_METRICS,
    RunId,
    append_run_log,
    best_run,
    run_log_rows,
)
from oddsmith.session import ensure_checkpoint_dir
from oddsmith.sources import pull_sql, read_table, replace_table
from oddsmith.sources.small import small_frame
from oddsmith.sources.tables import save_local_frame, table_name

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

SCRATCH = "oddsmith_scratch"
BASELINE = 0.5
ORDER_DATES = DateSplit("o_orderdate", "2000-01-01", "2001-01-01")
SHIP_DATES = DateSplit("l_shipdate", "2000-01-01", "2001-01-01")
# SQL pieces shared by several oracles.
ORDER_SPLIT = """CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train'
    WHEN o_orderdate < TIMESTAMP '2001-01-01' THEN 'val'
    WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'test' END"""
SHIP_SPLIT = ORDER_SPLIT.replace("o_orderdate", "l_shipdate")
def _key_sql(seed: str, *keys: str) -> str:
    """``key_hash`` in SQL."""
    parts = [f"coalesce(length(CAST({k} AS VARCHAR)) || ':' || CAST({k} AS VARCHAR), '-')" for k in keys]
    return f"md5('{seed}:' || {" || ':' || ".join(parts)})"


ORDER_HASH = _key_sql("42", "o_orderkey")
FOLD_HASH = _key_sql("fold-42", "o_orderkey")
LINE_SCORE = "l_extendedprice + 100 * l_quantity"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLES[name] = oracle
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_f() -> Column:
    return F.col("o_orderstatus") == "F"


def _null_when(condition: str, value: str) -> Column:
    return F.expr(f"CASE WHEN {condition} THEN NULL ELSE {value} END")


# --- sources and sinks


@query(
    "sql_pull",
    """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
       FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_orderstatus""",
)
def sql_pull(spark, sf_dir):
    return pull_sql(
        spark,
        f"""SELECT o_orderstatus, count(*) AS n,
                   CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
            FROM parquet.`{sf_dir}/orders.parquet`
            WHERE o_orderdate >= TIMESTAMP_NTZ '1998-01-01' GROUP BY o_orderstatus""",
    )


def _scratch(spark: SparkSession, name: str) -> str:
    """The name of a scratch table: the one of the last run is dropped, so that each query
    leaves one at most."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {SCRATCH}")
    spark.sql(f"DROP TABLE IF EXISTS {table_name(SCRATCH, name)}")
    return name


@query("table_roundtrip", "SELECT * FROM orders")
def table_roundtrip(spark, sf_dir):
    name = _scratch(spark, "orders_copy")
    replace_table(_table(spark, sf_dir, "orders"), name, SCRATCH)
    return read_table(spark, name, SCRATCH)


@query("local_frame_saved", "SELECT n_nationkey, n_name FROM nation")
def local_frame_saved(spark, sf_dir):
    """A local frame of a small table, saved and read."""
    local = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toPandas()
    name = _scratch(spark, "nations")
    save_local_frame(spark, local, name, SCRATCH)
    return read_table(spark, name, SCRATCH)


@query(
    "feature_roles",
    """SELECT * FROM (SELECT 'bigint' AS role, 'o_custkey' AS feature, count(o_custkey) AS present FROM orders
       UNION ALL SELECT 'double', 'o_totalprice', count(o_totalprice) FROM orders
       UNION ALL SELECT 'string', 'o_orderstatus', count(nullif(o_orderstatus, 'P')) FROM orders
       UNION ALL SELECT 'string', 'o_orderpriority', count(o_orderpriority) FROM orders)""",
)
def feature_roles(spark, sf_dir):
    """Which features were accepted under which role, and the rows that have each."""
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    roles = {
        "int": ["o_custkey"], "float": ["o_totalprice"], "string": ["o_orderstatus", "o_orderpriority"]
    }
    features = check_roles(orders, roles)
    kinds = dict(orders.dtypes)
    present = project_roles(orders, features[1:], features[0]).agg(*[F.count(name).alias(name) for name in features])
    each = [F.struct(F.lit(kinds[name]).alias("role"), F.lit(name).alias("feature"), F.col(name).alias("present")) for name in features]
    return present.select(F.inline(F.array(*each)))


# --- names and keys


@query("shorten_columns", "SELECT * FROM customer")
def shorten(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    return shorten_columns(customer.toDF(*[f"v.{name}" for name in customer.columns]))


@query(
    "primary_key_check",
    """SELECT CAST(t AS BIGINT) AS total_rows, CAST(d AS BIGINT) AS distinct_keys,
              t = d AS is_primary_key
       FROM (SELECT (SELECT count(*) FROM orders) AS t,
                    (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders)) AS d)""",
)
def key_check(spark, sf_dir):
    return primary_key_check(_table(spark, sf_dir, "orders"), "o_orderkey")


@query(
    "primary_key_check_composite",
    """SELECT CAST(t AS BIGINT) AS total_rows, CAST(d AS BIGINT) AS distinct_keys,
              t = d AS is_primary_key
       FROM (SELECT (SELECT count(*) FROM lineitem) AS t,
                    (SELECT count(*) FROM
                        (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS d)""",
)
def key_check_composite(spark, sf_dir):
    return primary_key_check(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- profiles


def _rate_oracle(criterion: str, ratio: str) -> str:
    return f"""WITH t AS (SELECT o_orderpriority, {criterion} AS c FROM orders),
        g AS (SELECT o_orderpriority, count(c) AS n, count(CASE WHEN c THEN 1 END) AS k
              FROM t GROUP BY o_orderpriority)
        SELECT o_orderpriority, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS n_filled,
               {ratio} AS p_filled FROM g"""


_ROUNDED = "CASE WHEN n > 0 THEN ((2 * k * 100000 + n) // (2 * n)) / 100000.0 END"
_SOME_NULL = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus = 'F' END"


@query("n_and_p", _rate_oracle("o_orderstatus = 'F'", _ROUNDED))
def n_and_p(spark, sf_dir):
    return outcome_rate(
        _table(spark, sf_dir, "orders"), "o_orderpriority", _is_f(), name="filled"
    )


@query("n_and_p_nulls", _rate_oracle(_SOME_NULL, _ROUNDED))
def n_and_p_nulls(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return outcome_rate(
        orders.withColumn("filled", F.expr(_SOME_NULL)), "o_orderpriority", "filled", order="p"
    )


@query("n_and_p_raw", _rate_oracle("o_orderstatus = 'F'", "k / nullif(n, 0)"))
def n_and_p_raw(spark, sf_dir):
    return outcome_rate(
        _table(spark, sf_dir, "orders"), "o_orderpriority", _is_f(), name="filled", digits=None
    )


@query(
    "bar_mean",
    """SELECT event_type, round(avg(value), 6) AS mean_value, CAST(count(value) AS BIGINT) AS n
       FROM events GROUP BY event_type""",
)
def bar_mean(spark, sf_dir):
    means = mean_by(_table(spark, sf_dir, "events"), "event_type", "value")
    return means.withColumn("mean_value", F.round("mean_value", 6))


_POISSON = " + ".join(f"(bits >= {bound})::INT" for bound in POISSON_BOUNDS)


@query(
    "bar_mean_intervals",
    f"""WITH drawn AS (
          SELECT event_type, value, 4 * block + part AS replicate, CAST('0x' || substr(
            md5('0:' || block || ':' || coalesce(event_id::VARCHAR, '')), CAST(8 * part + 1 AS INT), 8) AS BIGINT) AS bits
          FROM events, range(25) AS b(block), range(4) AS p(part) WHERE value IS NOT NULL),
        sums AS (
          SELECT event_type, replicate, sum(weight * value) / sum(weight) AS mean
          FROM (SELECT event_type, value, replicate, {_POISSON} AS weight FROM drawn)
          GROUP BY ALL HAVING sum(weight) > 0),
        ranked AS (
          SELECT event_type, mean, row_number() OVER (PARTITION BY event_type ORDER BY mean) AS place,
            count(*) OVER (PARTITION BY event_type) AS places FROM sums),
        ends AS (
          SELECT event_type, min(mean) FILTER (place = greatest(ceil(round(0.025 * places, 9)), 1)) AS low,
            min(mean) FILTER (place = ceil(round(0.975 * places, 9))) AS high FROM ranked GROUP BY 1),
        means AS (SELECT event_type, avg(value) AS mean, count(value) AS n FROM events GROUP BY 1)
        SELECT m.event_type, round(mean, 6) AS mean_value, n, round(low, 6) AS low_value, round(high, 6) AS high_value
        FROM means m LEFT JOIN ends e ON m.event_type IS NOT DISTINCT FROM e.event_type""",
)
def bar_mean_intervals(spark, sf_dir):
    """A bar's mean and the ends of its bootstrap interval, of 100 replicates."""
    found = mean_intervals(_table(spark, sf_dir, "events"), "event_type", "value", "event_id")
    for name in ("mean_value", "low_value", "high_value"):
        found = found.withColumn(name, F.round(name, 6))
    return found


# --- splits


@query("split_by_dates", f"SELECT o_orderkey, {ORDER_SPLIT} AS split FROM orders")
def by_dates(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return split_by_dates(orders, "o_orderdate", "2000-01-01", "2001-01-01").select(
        "o_orderkey", "split"
    )


@query(
    "split_shapes",
    f"""SELECT {ORDER_SPLIT} AS split, CAST(count(*) AS BIGINT) AS n_rows,
               2 AS n_features, 1 AS n_targets FROM orders GROUP BY 1""",
)
def shapes(spark, sf_dir):
    return split_shapes(ORDER_DATES.apply(_table(spark, sf_dir, "orders")), n_features=2)


@query(
    "split_target_distribution",
    f"""SELECT split, target, CAST(n AS BIGINT) AS n, n / sum(n) OVER (PARTITION BY split)
               AS fraction
        FROM (SELECT {ORDER_SPLIT} AS split, CAST(o_orderstatus = 'F' AS INT) AS target,
                     count(*) AS n FROM orders GROUP BY 1, 2)""",
)
def target_shares(spark, sf_dir):
    split = ORDER_DATES.apply(_table(spark, sf_dir, "orders"))
    return target_distribution(split.withColumn("target", _is_f().cast("int")), "target")


@query(
    "anchor_windows",
    """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '2001-06-02' THEN 'train'
                               WHEN o_orderdate < TIMESTAMP '2001-07-02' THEN 'val'
                               ELSE 'test' END AS split
       FROM orders
       WHERE o_orderdate >= TIMESTAMP '2001-02-02' AND o_orderdate < TIMESTAMP '2001-08-01'""",
)
def windows_back_from_anchor(spark, sf_dir):
    dates = anchor_windows("2001-08-01")
    return split_by_dates(
        _table(spark, sf_dir, "orders"),
        "o_orderdate",
        dates.val_start,
        dates.test_start,
        start=dates.start,
        end=dates.end,
    ).select("o_orderkey", "split")


@query(
    "split_random",
    f"""SELECT o_orderkey, CASE WHEN {ORDER_HASH} < '4' THEN 'test'
                                ELSE 'train' END AS split FROM orders""",
)
def random_split(spark, sf_dir):
    return split_random(_table(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey", "split"
    )


@query(
    "split_random_exact",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {ORDER_HASH})
                                <= ceil(count(*) OVER () * 0.25) THEN 'test'
                                ELSE 'train' END AS split FROM orders""",
)
def random_split_exact(spark, sf_dir):
    return split_random(_table(spark, sf_dir, "orders"), "o_orderkey", exact=True).select(
        "o_orderkey", "split"
    )


@query(
    "split_random_composite",
    f"""SELECT conv_id, turn, CASE WHEN row_number() OVER (ORDER BY {_key_sql("42", "conv_id", "turn")})
                                <= ceil(count(*) OVER () * 0.25) THEN 'test'
                                ELSE 'train' END AS split FROM conversations""",
)
def random_split_composite(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return split_random(turns, ["conv_id", "turn"], exact=True).select("conv_id", "turn", "split")


def _stratified_oracle(stratum: str) -> str:
    return f"""WITH c AS (SELECT {stratum} AS s, count(*) AS n FROM orders GROUP BY 1),
        w AS (SELECT CAST(sum(n) AS BIGINT) AS a,
                     CAST(sum(n) - ceil(sum(n) * 0.25) AS BIGINT) AS b FROM c),
        q AS (SELECT s, n, n * b // a AS low, n * b % a AS rest, b FROM c, w),
        r AS (SELECT s, n, low, row_number() OVER (ORDER BY rest DESC, {_key_sql("stratum", "s")}) AS place,
                     b - sum(low) OVER () AS missing FROM q),
        k AS (SELECT s, n - low - CASE WHEN place <= missing THEN 1 ELSE 0 END AS tests FROM r),
        h AS (SELECT o_orderkey, {stratum}, row_number() OVER (
                PARTITION BY {stratum} ORDER BY {ORDER_HASH}) AS place FROM orders)
        SELECT o_orderkey, {stratum},
               CASE WHEN place <= tests THEN 'test' ELSE 'train' END AS split
        FROM h JOIN k ON h.{stratum} = k.s"""


@query("split_stratified", _stratified_oracle("o_orderstatus"))
def stratified_split(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    split = split_random(orders, "o_orderkey", stratify="o_orderstatus")
    return split.select("o_orderkey", "o_orderstatus", "split")


@query("split_stratified_by_customer", _stratified_oracle("o_custkey"))
def stratified_split_by_customer(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    split = split_random(orders, "o_orderkey", stratify="o_custkey")
    return split.select("o_orderkey", "o_custkey", "split")


@query(
    "stratified_folds",
    f"""WITH h AS (SELECT o_orderkey, o_orderstatus,
                row_number() OVER (PARTITION BY o_orderstatus ORDER BY {FOLD_HASH}) AS place,
                count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
        SELECT o_orderkey, o_orderstatus, CAST(CASE WHEN place <= n // 4 THEN 0
               WHEN place <= n * 2 // 4 THEN 1 WHEN place <= n * 3 // 4 THEN 2 ELSE 3 END AS INT) AS fold
        FROM h""",
)
def stratified_folds(spark, sf_dir):
    return assign_folds(
        _table(spark, sf_dir, "orders"), "o_orderkey", 4, stratify="o_orderstatus"
    ).select("o_orderkey", "o_orderstatus", "fold")


# --- encoders


@query(
    "impute_mean",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v
                  FROM events)
       SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM t)), 4) AS x_v FROM t""",
)
def impute_mean(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn(
        "v", _null_when("event_id % 5 = 0", "value")
    )
    fitted = FeatureEncoder([MeanImpute(["v"])]).fit(events)
    return fitted.transform(events).select("event_id", F.round("x_v", 4).alias("x_v"))


@query(
    "flag_positive",
    """SELECT p_partkey, CAST(coalesce(CASE WHEN p_partkey % 6 = 0 THEN NULL
                              ELSE p_size - 25 END, 0) > 0 AS INT) AS flag FROM part""",
)
def positive(spark, sf_dir):
    part = _table(spark, sf_dir, "part").withColumn(
        "v", _null_when("p_partkey % 6 = 0", "p_size - 25")
    )
    return part.select("p_partkey", F.expr(flag_positive("v")).alias("flag"))


@query(
    "flag_true",
    f"SELECT o_orderkey, CAST(coalesce({_SOME_NULL}, FALSE) AS INT) AS flag FROM orders",
)
def true_flag(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").withColumn("v", F.expr(_SOME_NULL))
    return orders.select("o_orderkey", F.expr(flag_true("v")).alias("flag"))


@query(
    "bucket_category",
    """SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')
                              THEN c_mktsegment ELSE 'other' END AS segment FROM customer""",
)
def bucket_category(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer").withColumn(
        "v", _null_when("c_custkey % 9 = 0", "c_mktsegment")
    )
    kept = keep_listed("v", ["BUILDING", "MACHINERY"])
    return customer.select("c_custkey", F.expr(kept).alias("segment"))


@query(
    "ordinal_map",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS code
       FROM events""",
)
def ordinal_map(spark, sf_dir):
    code = code_of("event_type", {"click": 0, "view": 1}, 2)
    return _table(spark, sf_dir, "events").select("event_id", F.expr(code).alias("code"))


def _one_hot(df: DataFrame, column: str, *keys: str) -> DataFrame:
    fitted = FeatureEncoder([Categories(column)]).fit(df)
    return fitted.transform(df).select(*keys, *fitted.stages[-1].getInputCols())


@query(
    "one_hot",
    "SELECT c_custkey, "
    + ", ".join(
        f"CAST(c_mktsegment = '{s}' AS INT) AS x_c_mktsegment_{s}"
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer",
)
def one_hot(spark, sf_dir):
    return _one_hot(_table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")


@query(
    "one_hot_binary",
    """SELECT l_orderkey, l_linenumber, CAST(l_linestatus = 'O' AS INT) AS x_l_linestatus_O
       FROM lineitem""",
)
def one_hot_binary(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    return _one_hot(lines, "l_linestatus", "l_orderkey", "l_linenumber")


def _order_features(spark: SparkSession, sf_dir: str) -> PreparedData:
    """Orders with every kind of branch: floats, ints, booleans, three categories."""
    orders = _table(spark, sf_dir, "orders").select(
        "*",
        _null_when("o_orderkey % 5 = 0", "o_totalprice").alias("price"),
        _null_when("o_orderkey % 6 = 0", "o_custkey % 10 - 5").alias("balance"),
        _null_when("o_orderkey % 7 = 0", "o_totalprice > 300000").alias("large"),
        _is_f().cast("int").alias("target"),
        F.expr("substr(o_orderpriority, 1, 1)").alias("rank"),
    )
    branches = [
        MeanImpute(["price"]),
        PositiveFlag(["balance"]),
        TrueFlag(["large"]),
        KeepList("o_orderpriority", ["1-URGENT", "2-HIGH"]),
        CodeMap("rank", {"1": 0, "2": 1}, 2),
    ]
    encoder = FeatureEncoder(branches)
    data = ExperimentData(orders, "target", encoder.inputs, "o_orderkey", ORDER_DATES)
    return prepare(data, encoder)


@query(
    "feature_matrix",
    f"""WITH t AS (SELECT o_orderkey, {ORDER_SPLIT} AS split,
                CAST(o_orderstatus = 'F' AS INT) AS label, o_orderpriority AS p,
                CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
                CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey % 10 - 5 END AS balance,
                CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice > 300000 END AS large
             FROM orders)
        SELECT o_orderkey, split, label,
            round(coalesce(price, (SELECT avg(price) FROM t WHERE split = 'train')), 4) AS x_price,
            CAST(coalesce(balance, 0) > 0 AS INT) AS x_balance,
            CAST(coalesce(large, FALSE) AS INT) AS x_large,
            CAST(p = '1-URGENT' AS INT) AS "x_o_orderpriority_1-URGENT",
            CAST(p = '2-HIGH' AS INT) AS "x_o_orderpriority_2-HIGH",
            CAST(p NOT IN ('1-URGENT', '2-HIGH') AS INT) AS x_o_orderpriority_other,
            CAST(p[1] = '1' AS INT) AS x_rank_0, CAST(p[1] = '2' AS INT) AS x_rank_1,
            CAST(p[1] NOT IN ('1', '2') AS INT) AS x_rank_2
        FROM t""",
)
def feature_matrix(spark, sf_dir):
    prepared = _order_features(spark, sf_dir)
    encoded = prepared.encoder.transform(prepared.data.rows())
    names = [name for name in prepared.encoder.stages[-1].getInputCols() if name != "x_price"]
    price = F.round("x_price", 4).alias("x_price")
    return encoded.select("o_orderkey", "split", "label", price, *[f"`{n}`" for n in names])


# --- exact evaluation


def _auc_oracle(by: str, score: str = LINE_SCORE) -> str:
    """One common table expression ``auc_of(split, auc)``."""
    return f"""s AS (SELECT {by} AS split, {score} AS v,
                    count(*) FILTER (l_returnflag = 'R') AS p,
                    count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1, 2),
        r AS (SELECT *, sum(n) OVER (PARTITION BY split ORDER BY v) AS cn FROM s),
        auc_of AS (SELECT split, CAST(sum(p) AS BIGINT) AS positives,
                    CAST(sum(n) AS BIGINT) AS negatives,
                    CAST(sum(p * (2 * cn - n)) AS DOUBLE)
                    / nullif(CAST(2 * sum(p) * sum(n) AS DOUBLE), 0) AS auc
                   FROM r GROUP BY split)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        "l_shipdate",
        (F.col("l_returnflag") == "R").alias("returned"),
        F.expr(LINE_SCORE).alias("score"),
        "l_quantity",
        "l_extendedprice",
    )


@query("auc", f"WITH {_auc_oracle('1')} SELECT positives, negatives, auc FROM auc_of")
def auc(spark, sf_dir):
    return roc_auc(_lines(spark, sf_dir), "returned", "score")


@query(
    "auc_by_split",
    f"WITH {_auc_oracle(SHIP_SPLIT)} SELECT split, positives, negatives, auc FROM auc_of",
)
def auc_by_split(spark, sf_dir):
    return roc_auc(SHIP_DATES.apply(_lines(spark, sf_dir)), "returned", "score", "split")


@query(
    "auc_against_baseline",
    f"""WITH {_auc_oracle(SHIP_SPLIT)} SELECT split, positives, negatives, auc,
        CAST({BASELINE} AS DOUBLE) AS baseline_auc, auc - CAST({BASELINE} AS DOUBLE) AS lift
        FROM auc_of""",
)
def auc_against_baseline(spark, sf_dir):
    return compare_with_baseline(auc_by_split(spark, sf_dir), BASELINE)


# The corners of a curve: points whose steps before and after differ in direction.
_CORNERS = f"""s AS (SELECT {LINE_SCORE} AS threshold, count(*) FILTER (l_returnflag = 'R') AS p,
                        count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
        r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, lead(p) OVER w AS next_p,
                     lead(n) OVER w AS next_n, sum(p) OVER () AS pos, sum(n) OVER () AS neg
              FROM s WINDOW w AS (ORDER BY threshold DESC)),
        corners AS (
          SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / pos AS tpr, fp / neg AS fpr
          FROM r WHERE next_p IS NULL OR p * next_n <> next_p * n
          UNION ALL SELECT CAST('infinity' AS DOUBLE), 0, 0, 0.0, 0.0)"""


@query("roc_vertices", f"WITH {_CORNERS} SELECT * FROM corners")
def corners_of_roc(spark, sf_dir):
    return roc_vertices(_lines(spark, sf_dir), "returned", "score")


@query(
    "roc_curve_bounded",
    f"""WITH {_CORNERS}, cells AS (SELECT *, floor((tpr + fpr) * 10 / 2) AS cell FROM corners)
        SELECT threshold, tp, fp, tpr, fpr FROM cells
        QUALIFY tp + fp = min(tp + fp) OVER (PARTITION BY cell) OR tp + fp = max(tp + fp) OVER (PARTITION BY cell)""",
)
def bounded_roc(spark, sf_dir):
    """The curve in 21 points at most: its area is within 1/20 of the exact one."""
    return roc_vertices(_lines(spark, sf_dir), "returned", "score", most=21)


@query(
    "roc_points",
    f"""WITH s AS (SELECT {LINE_SCORE} AS threshold, count(*) FILTER (l_returnflag = 'R') AS p,
                          count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
        r AS (SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp,
                     CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS pos,
                     CAST(sum(n) OVER () AS BIGINT) AS neg
              FROM s WINDOW w AS (ORDER BY threshold DESC))
        SELECT threshold, tp, fp, tp / pos AS tpr, fp / neg AS fpr FROM r""",
)
def roc_table(spark, sf_dir):
    return roc_points(_lines(spark, sf_dir), "returned", "score")


# --- regression


def _line_fit(spark: SparkSession, sf_dir: str) -> LinearFit:
    lines = _table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return LinearFit(lines.select(*keys), ["l_quantity"], "l_extendedprice")


@query(
    "ols_fit",
    """SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 5) AS value
       FROM lineitem UNION ALL
       SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 5) FROM lineitem""",
)
def ols_fit(spark, sf_dir):
    terms = _line_fit(spark, sf_dir).terms()
    return terms.withColumn("value", F.round("value", 5))


@query(
    "ols_predict",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b,
                         regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
       SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 4) AS prediction
       FROM lineitem, f""",
)
def ols_predict(spark, sf_dir):
    return _line_fit(spark, sf_dir).predict().select(
        "l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction")
    )


@query(
    "explained_variance",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b,
                         regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
       SELECT round(1 - var_pop(l_extendedprice - (a + b * l_quantity))
                        / var_pop(l_extendedprice), 9) AS explained_variance
       FROM lineitem, f""",
)
def variance_explained(spark, sf_dir):
    predicted = _line_fit(spark, sf_dir).predict()
    found = explained_variance(predicted, "l_extendedprice", "prediction")
    return found.withColumn("explained_variance", F.round("explained_variance", 9))


# --- classifiers
#
# A planted target, a price beyond 300,000 with one order in ten flipped, and the flag that
# tells it. With one 0/1 feature a fitted model has two scores, one per cell of the
# flag, so SQL can follow whole fits over whole tables.


def _planted_orders(spark: SparkSession, sf_dir: str, *more: TrueFlag) -> PreparedData:
    orders = _table(spark, sf_dir, "orders").select(
        "*",
        F.expr("o_totalprice > 300000").alias("large"),
        F.expr("o_orderkey % 2 = 0").alias("even"),
        F.expr(f"CAST({_PLANTED} AS int)").alias("target"),
    )
    encoder = FeatureEncoder([TrueFlag(["large"]), *more])
    data = ExperimentData(orders, "target", encoder.inputs, "o_orderkey", ORDER_DATES)
    return prepare(data, encoder)


_PLANTED = "(o_totalprice > 300000) <> (o_orderkey % 10 = 0)"
# Rows ``t``, and rows and positives of each cell of the train rows.
_CELLS = f"""t AS (SELECT o_orderkey, {ORDER_SPLIT} AS split, CAST({_PLANTED} AS INT) AS label,
                CAST(o_totalprice > 300000 AS INT) AS f FROM orders),
        cells AS (SELECT f, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS p
                  FROM t WHERE split = 'train' GROUP BY f)"""
# The first tree fits 2 * label - 1, each later one the negative gradient of the loss
# 2 * log(1 + exp(-2 * y * margin)), whose mean in a cell is the tree's value there.
_BOOSTED = f"""WITH RECURSIVE {_CELLS},
        grown AS (SELECT 1 AS trees, f, p / n AS q, 2 * p / n - 1 AS margin FROM cells
            UNION ALL
            SELECT trees + 1, f, q, margin + 0.05 * (q * 4 / (1 + exp(2 * margin))
                                                   - (1 - q) * 4 / (1 + exp(-2 * margin)))
            FROM grown WHERE trees < 100),
        scores AS (SELECT f, 1 / (1 + exp(-2 * margin)) AS score FROM grown WHERE trees = 100)"""
_FOREST = f"WITH {_CELLS}, scores AS (SELECT f, p / n AS score FROM cells)"
# Newton steps for sum(loss) + w * w / (2 * C), C = 1, over two cells: margins b and b + w.
_LOGIT = f"""WITH RECURSIVE {_CELLS},
        wide AS (SELECT max(n) FILTER (f = 0) AS n0, max(p) FILTER (f = 0) AS p0,
                        max(n) FILTER (f = 1) AS n1, max(p) FILTER (f = 1) AS p1 FROM cells),
        newton AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b FROM wide
            UNION ALL
            SELECT step + 1,
                   w - ((h0 + h1) * gw - h1 * gb) / ((h1 + 1) * (h0 + h1) - h1 * h1),
                   b - ((h1 + 1) * gb - h1 * gw) / ((h1 + 1) * (h0 + h1) - h1 * h1)
            FROM (SELECT step, w, b,
                         n1 / (1 + exp(-b - w)) - p1 + w AS gw,
                         n1 / (1 + exp(-b - w)) - p1 + n0 / (1 + exp(-b)) - p0 AS gb,
                         n1 / (1 + exp(-b - w)) / (1 + exp(b + w)) AS h1,
                         n0 / (1 + exp(-b)) / (1 + exp(b)) AS h0
                  FROM newton, wide WHERE step < 25)),
        scores AS (SELECT f, 1 / (1 + exp(-b - w * f)) AS score
                   FROM newton, (SELECT 0 AS f UNION ALL SELECT 1) WHERE step = 25)"""
_SCORED = "SELECT o_orderkey, split, label, round(score, {}) AS score FROM t JOIN scores USING (f) WHERE split IS NOT NULL"
# The AUC of a flag as score: ties count half.
_FLAG_AUC = """(CAST(2 * sum(label * f) * sum((1 - label) * (1 - f)) + sum(label * f) * sum((1 - label) * f)
            + sum(label * (1 - f)) * sum((1 - label) * (1 - f)) AS DOUBLE)
            / CAST(2 * sum(label) * sum(1 - label) AS DOUBLE))"""


def _scores(spark: SparkSession, sf_dir: str, estimator, digits: int) -> DataFrame:
    """Fit on the train orders, score all of them."""
    prepared = _planted_orders(spark, sf_dir)
    _checkpoints(spark)
    model = fit_on(prepared.train_rows(), estimator, "o_orderkey")
    rounded = F.round("score", digits).alias("score")
    return score(model, prepared.rows()).select("o_orderkey", "split", LABEL, rounded)


def _checkpoints(spark: SparkSession) -> None:
    """A folder for checkpoints where the session names none, as on one machine."""
    if ensure_checkpoint_dir(spark) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="checkpoint-"))


def _whole_forest(**options):
    """Trees over all rows: equal ones, so their mean is a cell's mean."""
    return random_forest(bootstrap=False, **options)


# Two features of several values, whose steps a second-order fit finds one after another.
_STEPPED = "(o_totalprice + 20000 * CAST(substr(o_orderpriority, 1, 1) AS INT) > 300000) <> (o_orderkey % 10 = 0)"
_STEPS = f"""t AS (SELECT o_orderkey, {ORDER_SPLIT} AS split, CAST({_STEPPED} AS INT) AS label,
                least(floor(o_totalprice / 50000), 8) AS a, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS b FROM orders)"""


def _stepped_orders(spark: SparkSession, sf_dir: str) -> PreparedData:
    orders = _table(spark, sf_dir, "orders").select(
        "*",
        F.expr("CAST(least(floor(o_totalprice / 50000), 8) AS DOUBLE) AS step"),
        F.expr("CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS rank"),
        F.expr(f"CAST({_STEPPED} AS INT) AS target"),
    )
    encoder = FeatureEncoder([MeanImpute(["step", "rank"])])
    return prepare(ExperimentData(orders, "target", encoder.inputs, "o_orderkey", ORDER_DATES), encoder)


def _grown(depth: int, most: int) -> str:
    """``grown``: the margins of ``state`` (cells a, b by fit) after 0 to ``most`` trees. A
    tree's levels follow one another; sums are whole numbers of 2**-30."""
    levels = []
    for at in range(depth):
        levels.append(f"""w{at} AS (SELECT *, sum(g) OVER u - g AS gl, sum(h) OVER u - h AS hl,
                sum(g) OVER (PARTITION BY fit, node, f) AS gt, sum(h) OVER (PARTITION BY fit, node, f) AS ht
              FROM (SELECT fit, node, f, v, CAST(sum(g) AS DOUBLE) / 1073741824 AS g, CAST(sum(h) AS DOUBLE) / 1073741824 AS h
                    FROM (SELECT fit, node, g, h, 0 AS f, a AS v FROM s{at} UNION ALL SELECT fit, node, g, h, 1, b FROM s{at})
                    GROUP BY ALL)
              WINDOW u AS (PARTITION BY fit, node, f ORDER BY v ROWS UNBOUNDED PRECEDING)),
            b{at} AS (SELECT fit, node, f, v
              FROM (SELECT *, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain
                    FROM w{at}) JOIN fits USING (fit)
              WHERE depth > {at} AND hl >= 1 AND ht - hl >= 1 AND gain > 0.000001
              QUALIFY row_number() OVER (PARTITION BY fit, node ORDER BY gain DESC, f, v) = 1),
            s{at + 1} AS (SELECT s.* REPLACE (2 * s.node + coalesce(CAST(CASE b{at}.f WHEN 0 THEN s.a >= b{at}.v ELSE s.b >= b{at}.v END
                                              AS INT), 0) AS node)
              FROM s{at} s LEFT JOIN b{at} ON s.fit = b{at}.fit AND s.node = b{at}.node)""")
    p = "(1 / (1 + exp(-margin)))"
    return f"""grown AS (SELECT 0 AS trees, *, CAST(0 AS DOUBLE) AS margin FROM state
          UNION ALL
          (WITH s0 AS (SELECT *, 0 AS node, CAST(round((n * {p} - p) * 1073741824) AS HUGEINT) AS g,
                              CAST(round(n * {p} * (1 - {p}) * 1073741824) AS HUGEINT) AS h FROM grown WHERE trees < {most}),
            {", ".join(levels)},
            leaves AS (SELECT fit, node, -rate * (CAST(sum(g) AS DOUBLE) / 1073741824)
                              / (CAST(sum(h) AS DOUBLE) / 1073741824 + 1) AS value
              FROM s{depth} JOIN fits USING (fit) GROUP BY fit, node, rate)
           SELECT * EXCLUDE (node, g, h, value) REPLACE (trees + 1 AS trees, margin + value AS margin)
           FROM s{depth} JOIN leaves USING (fit, node)))"""


@query(
    "second_order_scores",
    f"""WITH RECURSIVE {_STEPS},
        fits AS (SELECT 0 AS fit, 3 AS depth, CAST(0.05 AS DOUBLE) AS rate),
        state AS (SELECT 0 AS fit, a, b, count(*) AS n, sum(label) AS p FROM t WHERE split = 'train' GROUP BY a, b),
        {_grown(3, 100)}
        SELECT o_orderkey, split, label, round(1 / (1 + exp(-margin)), 7) AS score
        FROM t JOIN grown USING (a, b) WHERE split IS NOT NULL AND trees = 100""",
)
def second_order_scores(spark, sf_dir):
    """The declared 100 trees of depth 3, at a rate of 0.05."""
    prepared = _stepped_orders(spark, sf_dir)
    _checkpoints(spark)
    model = fit_on(prepared.train_rows(), SecondOrderTrees(maxDepth=3, stepSize=0.05, maxIter=100), "o_orderkey")
    return score(model, prepared.rows()).select("o_orderkey", "split", LABEL, F.round("score", 7).alias("score"))


@query("gbt_scores", f"{_BOOSTED} {_SCORED.format(9)}")
def gbt_scores(spark, sf_dir):
    return _scores(spark, sf_dir, boosted_trees(n_trees=100), 9)


@query("rf_scores", f"{_FOREST} {_SCORED.format(9)}")
def rf_scores(spark, sf_dir):
    return _scores(spark, sf_dir, _whole_forest(n_trees=100), 9)


@query("logreg_scores", f"{_LOGIT} {_SCORED.format(3)}")
def logreg_scores(spark, sf_dir):
    return _scores(spark, sf_dir, PenalizedLogit(C=1.0, penalty="l2"), 3)


@query(
    "feature_importance",
    f"""WITH t AS (SELECT CAST({_PLANTED} AS INT) AS label, o_totalprice > 300000 AS large,
                          o_orderkey % 2 = 0 AS even FROM orders
                   WHERE o_orderdate < TIMESTAMP '2000-01-01'),
        g AS (SELECT feature, sum(n * (1 - (p * p + (n - p) * (n - p)) / (n * n))) AS impurity
              FROM (SELECT 'large' AS feature, large AS v, CAST(count(*) AS DOUBLE) AS n,
                           CAST(sum(label) AS DOUBLE) AS p FROM t GROUP BY large
                    UNION ALL SELECT 'even', even, count(*), sum(label) FROM t GROUP BY even)
              GROUP BY feature)
        SELECT feature, CASE WHEN impurity = min(impurity) OVER () THEN 1.0 ELSE 0.0 END AS importance,
               CAST(row_number() OVER (ORDER BY impurity) AS INT) AS place FROM g""",
)
def importances(spark, sf_dir):
    """Of trees with one split: the best feature has it all. The order is part of it."""
    prepared = _planted_orders(spark, sf_dir, TrueFlag(["even"]))
    forest = _whole_forest(n_trees=100, max_depth=1, featureSubsetStrategy="all")
    model = fit_on(prepared.train_rows(), forest, "o_orderkey")
    found = feature_importance(model, prepared.names, prepared.data.df).collect()
    rows = [(r["feature"], r["importance"], at + 1) for at, r in enumerate(found)]
    return small_frame(spark, rows, "feature string, importance double, place int")


def _search_oracle(candidates: str, weightless: str = "FALSE") -> str:
    """Mean AUC over the folds. Any model that learns orders the two cells alike, so all
    have the flag's AUC; one whose weight is zero ties every score."""
    return f"""WITH {_CELLS},
        h AS (SELECT label, f, row_number() OVER (PARTITION BY label ORDER BY {FOLD_HASH}) AS place,
                     count(*) OVER (PARTITION BY label) AS m FROM t WHERE split = 'train'),
        folded AS (SELECT label, f, CASE WHEN place <= m // 4 THEN 0 WHEN place <= m * 2 // 4 THEN 1
                   WHEN place <= m * 3 // 4 THEN 2 ELSE 3 END AS fold FROM h),
        out_of AS (SELECT fold, {_FLAG_AUC} AS auc FROM folded GROUP BY fold),
        fitted AS (SELECT o.fold, abs(sum(CASE WHEN i.f = 1 THEN i.label - y.mean END)) AS slope
                   FROM (SELECT DISTINCT fold FROM folded) o JOIN folded i ON i.fold <> o.fold
                   JOIN (SELECT a.fold, avg(b.label) AS mean FROM (SELECT DISTINCT fold FROM folded) a
                         JOIN folded b ON b.fold <> a.fold GROUP BY a.fold) y ON y.fold = o.fold
                   GROUP BY o.fold),
        candidates AS ({candidates})
        SELECT CAST(candidate AS INT) AS candidate, params,
               round(avg(CASE WHEN {weightless} THEN 0.5 ELSE auc END), 9) AS mean_auc
        FROM candidates, out_of JOIN fitted USING (fold) GROUP BY candidate, params"""


def _listed(sets) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS candidate, '{params}' AS params, {c} AS c, '{penalty}' AS penalty"
                              for i, (params, c, penalty) in enumerate(sets))


def _searched(spark: SparkSession, sf_dir: str, search) -> DataFrame:
    prepared = _planted_orders(spark, sf_dir)
    _checkpoints(spark)
    found = search.fit(prepared.train_rows(), "o_orderkey")
    results = search_results(found, prepared.data.df)
    return results.withColumn("mean_auc", F.round("mean_auc", 9))


_BOOSTED_SETS = [(d, n, r) for d in (2, 3) for n in (50, 100, 150, 200) for r in (0.05, 0.3)]
_SHORT_SETS = [(d, n, r) for d in (2, 3) for n in (60, 100, 140, 180) for r in (0.3, 0.01)]
_FOREST_SETS = [
    (f"bootstrap={b}, featureSubsetStrategy=sqrt, maxDepth={d}, minInstancesPerNode={m}, numTrees={n}", 0, "")
    for b in (True, False) for d in (2, 4) for m in (1, 2) for n in (2, 3)
]
_LOGIT_SETS = [
    (f"C={c}, penalty={penalty}", c, penalty)
    for c in (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0) for penalty in ("l1", "l2")
]


def _staged_oracle(sets) -> str:
    """Each fit of a fold followed tree by tree, and judged by the rows that it left out."""
    fits = list(dict.fromkeys((d, r) for d, _, r in sets))
    told = " UNION ALL ".join(
        f"SELECT {fits.index((d, r))} AS own, {i} AS candidate, {n} AS trees, 'maxDepth={d}, maxIter={n}, stepSize={r}' AS params"
        for i, (d, n, r) in enumerate(sets)
    )
    each = " UNION ALL ".join(f"SELECT {i} AS own, {d} AS depth, CAST({r} AS DOUBLE) AS rate" for i, (d, r) in enumerate(fits))
    return f"""WITH RECURSIVE {_STEPS},
        h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {FOLD_HASH}) AS place,
                     count(*) OVER (PARTITION BY label) AS m FROM t WHERE split = 'train'),
        folded AS (SELECT a, b, label, CASE WHEN place <= m // 4 THEN 0 WHEN place <= m * 2 // 4 THEN 1
                   WHEN place <= m * 3 // 4 THEN 2 ELSE 3 END AS fold FROM h),
        fits AS (SELECT own * 4 + fold AS fit, own, depth, rate FROM ({each}), (SELECT unnest(range(4)) AS fold)),
        state AS (SELECT fit, a, b, count(*) FILTER (fold <> fit % 4) AS n, coalesce(sum(label) FILTER (fold <> fit % 4), 0) AS p,
                         count(*) FILTER (fold = fit % 4) AS out_n, coalesce(sum(label) FILTER (fold = fit % 4), 0) AS out_p
                  FROM folded, fits GROUP BY fit, a, b),
        {_grown(max(d for d, _, _ in sets), max(n for _, n, _ in sets))},
        candidates AS ({told}),
        c AS (SELECT fit, trees, sum(out_p) AS p, sum(out_n - out_p) AS n, 1 / (1 + exp(-margin)) AS score
              FROM grown JOIN fits USING (fit) JOIN candidates USING (own, trees) GROUP BY ALL),
        ranked AS (SELECT *, 2 * sum(n) OVER (PARTITION BY fit, trees ORDER BY score) - n AS won FROM c),
        aucs AS (SELECT fit, trees, CAST(sum(p * won) AS DOUBLE) / CAST(2 * sum(p) * sum(n) AS DOUBLE) AS auc
                 FROM ranked GROUP BY fit, trees)
        SELECT CAST(candidate AS INT) AS candidate, params, round(avg(auc), 9) AS mean_auc
        FROM candidates JOIN fits USING (own) JOIN aucs USING (fit, trees) GROUP BY candidate, params"""


def _staged(spark: SparkSession, sf_dir: str, search) -> DataFrame:
    prepared = _stepped_orders(spark, sf_dir)
    _checkpoints(spark)
    results = search_results(search.fit(prepared.train_rows(), "o_orderkey"), prepared.data.df)
    return results.withColumn("mean_auc", F.round("mean_auc", 9))


@query("grid_search", _staged_oracle(_BOOSTED_SETS))
def grid(spark, sf_dir):
    """16 of the 256 declared sets: all four declared tree counts (up to 200), two declared
    depths and rates. Sixteen fits of the folds and four of all rows share their passes."""
    return _staged(spark, sf_dir, boosted_tree_search(depths=(2, 3), learning_rates=(0.05, 0.3)))


@query("grid_search_short", _staged_oracle(_SHORT_SETS))
def grid_short(spark, sf_dir):
    """16 of the second grid's 128 declared sets: all four declared tree counts (up to 180),
    two declared depths and rates."""
    return _staged(spark, sf_dir, boosted_tree_search_short(depths=(2, 3), learning_rates=(0.3, 0.01)))


@query("grid_search_forest", _search_oracle(_listed(_FOREST_SETS)))
def grid_forest(spark, sf_dir):
    """16 sets: 64 fits and one of the best. Two declared values of every dimension that has
    several, but the tree counts, 2 and 3, lie outside the declared grid (100 to 300)."""
    search = random_forest_search(depths=(2, 4), rows_per_leaf=(1, 2), n_trees=(2, 3))
    return _searched(spark, sf_dir, search)


@query(
    "fold_encoders",
    f"""WITH h AS (SELECT o_orderpriority AS c, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS x,
                      row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY {FOLD_HASH}) AS place,
                      count(*) OVER (PARTITION BY o_orderstatus = 'F') AS m FROM orders),
        f AS (SELECT c, x, CASE WHEN place <= m // 4 THEN 0 WHEN place <= m * 2 // 4 THEN 1
                           WHEN place <= m * 3 // 4 THEN 2 ELSE 3 END AS fold FROM h),
        o AS (SELECT CAST(k AS INT) AS fold, c, x FROM f, (SELECT unnest(range(4)) AS k) WHERE fold <> k)
        SELECT fold, round(avg(x), 6) AS mean, CAST(count(DISTINCT c) AS INT) AS categories FROM o GROUP BY fold""",
)
def fold_encoders(spark, sf_dir):
    """What the encoder of each fold has learned from the others."""
    orders = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus = 'F' AS target", "o_orderpriority",
        "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price",
    )
    encoder = FeatureEncoder([MeanImpute(["price"]), Categories("o_orderpriority", limit=100)])
    folded = assign_folds(orders, ["o_orderkey"], 4, 42, stratify="target")
    missing = orders.limit(1).withColumn("price", F.lit(None).cast("double"))
    found = None
    for fold, model in enumerate(encoder.fit_without(folded, "fold", 4)):
        names = feature_names(model)
        told = model.transform(missing).select(
            F.lit(fold).alias("fold"), F.round("x_price", 6).alias("mean"), F.lit(len(names) - 1).alias("categories")
        )
        found = told if found is None else found.unionByName(told)
    return found


@query(
    "grid_search_logistic",
    # The gradient at a weight of zero says whether the l1 penalty leaves any.
    _search_oracle(_listed(_LOGIT_SETS), "penalty = 'l1' AND c * slope <= 1"),
)
def grid_logistic(spark, sf_dir):
    """All 14 sets: 56 fits and one of the best."""
    return _searched(spark, sf_dir, logistic_search())


# --- runs

_SPLIT_AUCS = f"aucs AS (SELECT split, {_FLAG_AUC} AS auc FROM t WHERE split IS NOT NULL GROUP BY split)"


def _metrics_oracle(splits: str) -> str:
    return f"""WITH {_CELLS}, {_SPLIT_AUCS}
        SELECT split, auc, CAST({BASELINE} AS DOUBLE) AS baseline_auc, auc - {BASELINE} AS lift
        FROM aucs WHERE split IN ({splits})"""


def _run(spark: SparkSession, sf_dir: str, estimator, *splits: str, **options):
    _checkpoints(spark)
    return run_experiment(_planted_orders(spark, sf_dir), estimator, splits=splits, **options)


@query("experiment_train_val", _metrics_oracle("'train', 'val'"))
def experiment_train_val(spark, sf_dir):
    run = _run(spark, sf_dir, boosted_trees(n_trees=100), "train", "val", baseline_auc=BASELINE)
    return run.metrics


@query("experiment_train_val_test", _metrics_oracle("'train', 'val', 'test'"))
def experiment_train_val_test(spark, sf_dir):
    forest = _whole_forest(n_trees=100)
    return _run(spark, sf_dir, forest, "train", "val", "test", baseline_auc=BASELINE).metrics


@query(
    "experiment_roc",
    f"""{_FOREST},
        s AS (SELECT split, score, sum(label) AS p, sum(1 - label) AS n
              FROM t JOIN scores USING (f) WHERE split IS NOT NULL GROUP BY split, score),
        r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY split) AS pos,
                     sum(n) OVER (PARTITION BY split) AS neg FROM s
              WINDOW w AS (PARTITION BY split ORDER BY score DESC))
        SELECT split, round(score, 9) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
               CAST(tp AS DOUBLE) / CAST(pos AS DOUBLE) AS tpr, CAST(fp AS DOUBLE) / CAST(neg AS DOUBLE) AS fpr
        FROM r""",
)
def experiment_roc(spark, sf_dir):
    run = _run(spark, sf_dir, _whole_forest(n_trees=100), "train", "val", "test")
    return run.roc().withColumn("threshold", F.round("threshold", 9))


@query(
    "experiment_log",
    f"""WITH {_CELLS}, {_SPLIT_AUCS}
        SELECT 7 AS experiment_id, 'logit' AS run_name, 'metric' AS kind,
               CASE split WHEN 'train' THEN 'TrainAUC' WHEN 'val' THEN 'ValAUC' ELSE 'TestAUC' END AS key,
               CAST(NULL AS VARCHAR) AS value, auc AS value_num FROM aucs
        UNION ALL SELECT 7, 'logit', 'metric', 'BaselineAUC', NULL, {BASELINE}
        UNION ALL SELECT 7, 'logit', 'param', 'C', '0.1', NULL
        UNION ALL SELECT 7, 'logit', 'param', 'penalty', 'l1', NULL
        UNION ALL SELECT 7, 'logit', 'tag', 'description', 'all orders', NULL
        UNION ALL SELECT 7, 'logit', 'tag', 'feature_names', 'large', NULL""",
)
def experiment_log(spark, sf_dir):
    run = _run(
        spark, sf_dir, PenalizedLogit(C=0.1, penalty="l1"), "train", "val", "test",
        baseline_auc=BASELINE, description="all orders", run_name="logit", experiment_id=7,
    )
    # Of the parameters those that the estimator itself has; Spark's version is a tag, too.
    told = "(kind <> 'param' OR key IN ('C', 'penalty')) AND key <> 'spark_version'"
    return run.log.where(told).select("experiment_id", "run_name", "kind", "key", "value", "value_num")


@query(
    "model_params",
    """SELECT 'C' AS key, '10.0' AS value UNION ALL SELECT 'penalty', 'l1'
       UNION ALL SELECT 'elasticNetParam', '1.0' UNION ALL SELECT 'standardization', 'False'""",
)
def chosen_params(spark, sf_dir):
    """Of a search over one set: its own parameters beside those of Spark's model."""
    prepared = _planted_orders(spark, sf_dir)
    search = logistic_search(strengths=(10.0,), penalties=("l1",))
    found = model_params(search.fit(prepared.train_rows(), "o_orderkey"))
    told = [(k, found[k]) for k in ("C", "penalty", "elasticNetParam", "standardization")]
    return small_frame(spark, told, "key string, value string")


@query(
    "repeated_experiments",
    f"""WITH {_CELLS}, {_SPLIT_AUCS}
        SELECT experiment_id, run_name, auc AS value, CAST(3 AS BIGINT) AS runs
        FROM aucs, (SELECT 422 AS experiment_id, 'forest' AS run_name) WHERE split = 'val'""",
)
def repeated_experiments(spark, sf_dir):
    """Three runs over shared train rows, in one log; the best of equal ones is the first."""
    _checkpoints(spark)
    runs = run_experiments(
        _planted_orders(spark, sf_dir),
        {
            "logit": PenalizedLogit(C=1.0, penalty="l2"),
            "forest": _whole_forest(n_trees=100),
            "trees": boosted_trees(n_trees=100),
        },
        experiment_id=422,
        baseline_auc=BASELINE,
    )
    name = _scratch(spark, "repeated_runs")
    for told, run in runs.items():
        append_run_log(run.log.withColumn("run_name", F.lit(told)), name, SCRATCH)
    log = read_table(spark, name, SCRATCH)
    count = F.lit(log.select("run_id").distinct().count())
    return best_run(log, SPLIT_METRICS["val"]).drop("run_id").withColumn("runs", count.cast("long"))


# Fixed scores stand for models, so that SQL can follow the whole run log.
_CANDIDATES = {
    "by_both": LINE_SCORE,
    "by_price": "l_extendedprice",
    "by_quantity": "l_quantity",
}
_RUN_ORACLE = "\n UNION ALL ".join(
    f"SELECT '{name}' AS run_name, split, auc FROM "
    f"(WITH {_auc_oracle(SHIP_SPLIT, expression)} SELECT split, auc FROM auc_of)"
    for name, expression in _CANDIDATES.items()
)


def _candidate_runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The log of one run per candidate score."""
    # One read of the table serves all candidates: each row once per score.
    named = [
        F.struct(F.lit(name).alias("run_name"), F.expr(expression).cast("double").alias("score"))
        for name, expression in _CANDIDATES.items()
    ]
    lines = SHIP_DATES.apply(_table(spark, sf_dir, "lineitem"))
    scored = lines.select(
        "split", (F.col("l_returnflag") == "R").alias("returned"), F.inline(F.array(*named))
    )
    found = roc_auc(scored, "returned", "score", ["run_name", "split"]).collect()
    return [
        run_log_rows(
            spark,
            RunId(422, run_id=name, run_name=name),
            description="fixed score",
            baseline_auc=BASELINE,
            aucs={row["split"]: row["auc"] for row in found if row["run_name"] == name},
            importances={},
            params={"score": expression},
            feature_names=["l_extendedprice", "l_quantity"],
        )
        for name, expression in _CANDIDATES.items()
    ]


@query(
    "run_log",
    f"""WITH runs AS ({_RUN_ORACLE})
        SELECT 422 AS experiment_id, run_name, CASE split WHEN 'train' THEN 'TrainAUC'
               WHEN 'val' THEN 'ValAUC' ELSE 'TestAUC' END AS key, auc AS value_num FROM runs
        UNION ALL SELECT DISTINCT 422, run_name, 'BaselineAUC', CAST({BASELINE} AS DOUBLE)
        FROM runs""",
)
def run_log(spark, sf_dir):
    name = _scratch(spark, "fixed_runs")
    for rows in _candidate_runs(spark, sf_dir):
        append_run_log(rows, name, SCRATCH)
    log = read_table(spark, name, SCRATCH).filter(F.col("kind") == "metric")
    return log.select("experiment_id", "run_name", "key", "value_num")


@query(
    "best_run",
    f"""WITH runs AS ({_RUN_ORACLE})
        SELECT 422 AS experiment_id, run_name AS run_id, run_name, auc AS value FROM runs
        WHERE split = 'val' ORDER BY auc DESC, run_name LIMIT 1""",
)
def best(spark, sf_dir):
    first, *others = _candidate_runs(spark, sf_dir)
    for rows in others:
        first = first.unionByName(rows)
    return best_run(first, SPLIT_METRICS["val"])


# --- training corpora, if the package for them is there

try:
    import corpus_pipeline
    from oddsmith.llm import queries as llm_queries
except ImportError:
    pass  # the rest works without it
else:
    _QUERIES.update(llm_queries.QUERIES)
    _ORACLES.update(llm_queries.ORACLES)
    _QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        _ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """The outcome rate of orders by priority."""
    return n_and_p(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
