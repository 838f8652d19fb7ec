import pandas as pd
import pytest

from oddsmith.operators.keys import is_primary_key, primary_key_check
from oddsmith.operators.schema import check_roles, project_roles, shorten_columns
from oddsmith.sources import (
    pull_jdbc,
    pull_sql,
    read_table,
    replace_table,
    save_local_frame,
)
from oddsmith.sources.small import small_frame


@pytest.fixture(scope="module")
def schema(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS made")
    return "made"


def test_pull_sql_reports_rows(spark, caplog):
    with caplog.at_level("INFO"):
        pulled = pull_sql(spark, "SELECT id FROM range(7)", report_rows=True)
    assert pulled.count() == 7
    assert "7 rows" in caplog.text


def test_pull_jdbc_wants_all_of_a_partitioning(spark):
    with pytest.raises(ValueError, match="lower"):
        pull_jdbc(spark, "jdbc:none:", "SELECT 1", partition_column="id")


def test_replacing_a_table_replaces_its_schema(spark, schema):
    replace_table(spark.range(3), "t1", schema)
    replace_table(spark.range(2).selectExpr("id AS other", "1 AS more"), "t1", schema)
    assert read_table(spark, "t1", schema).columns == ["other", "more"]
    assert read_table(spark, f"{schema}.t1").count() == 2


def test_replacing_a_table_by_its_own_rows(spark, schema):
    replace_table(spark.range(10), "t2", schema)
    replace_table(read_table(spark, "t2", schema).filter("id < 4"), "t2", schema, reads_itself=True)
    assert read_table(spark, "t2", schema).count() == 4


def test_partitioned_table(spark, schema):
    replace_table(spark.range(10).selectExpr("id", "id % 2 AS p"), "t3", schema, partition_by=["p"])
    assert read_table(spark, "t3", schema).filter("p = 1").count() == 5


def test_local_frame(spark, schema):
    save_local_frame(spark, pd.DataFrame({"a": [1, 2], "b": ["x", None]}), "t4", schema)
    assert {tuple(r) for r in read_table(spark, "t4", schema).collect()} == {(1, "x"), (2, None)}


def test_small_frame_keeps_types_and_nulls(spark):
    rows = [("a", None, 1.5, [1, 2]), (None, None, None, [])]
    frame = small_frame(spark, rows, "s string, i int, d double, l array<bigint>")
    assert frame.schema.simpleString() == "struct<s:string,i:int,d:double,l:array<bigint>>"
    assert [tuple(r) for r in frame.collect()] == rows
    assert small_frame(spark, [], "s string, d double").count() == 0


def test_shorten_takes_the_second_segment(spark):
    frame = spark.createDataFrame([(1, 2, 3)], ["v.a", "a.b.c", "plain"])
    assert shorten_columns(frame).columns == ["a", "b", "plain"]


def test_shorten_empty_segment(spark):
    assert shorten_columns(spark.createDataFrame([(1, 2)], ["a.", "b"])).columns == ["", "b"]


def test_shorten_collision(spark):
    frame = spark.createDataFrame([(1, 2, 3)], ["a.id", "b.id", "id_2"])
    with pytest.raises(ValueError, match="id"):
        shorten_columns(frame)
    short = shorten_columns(frame, on_collision="suffix")
    assert short.columns == ["id", "id_3", "id_2"]
    assert tuple(short.select("id", "id_3", "id_2").first()) == (1, 2, 3)


def test_roles(spark):
    frame = spark.createDataFrame([(1, 1.0, True, "x")], "i int, d double, b boolean, s string")
    roles = {"boolean": ["b"], "float": ["d"], "int": ["i"], "string": ["s"]}
    assert check_roles(frame, roles) == ["b", "d", "i", "s"]
    with pytest.raises(ValueError, match="nope: no such column; s: string is no float"):
        check_roles(frame, {"int": ["nope"], "float": ["s"]})
    assert project_roles(frame, ["d", "s"], "b", "i").columns == ["i", "b", "d", "s"]


@pytest.mark.parametrize(
    "rows, total, distinct, verdict",
    [
        ([(1,), (2,), (3,)], 3, 3, True),
        ([(1,), (2,), (2,)], 3, 2, False),
        ([(1,), (None,)], 2, 2, True),
        ([(None,), (None,)], 2, 1, False),
        ([], 0, 0, True),
    ],
)
def test_primary_key(spark, rows, total, distinct, verdict):
    frame = spark.createDataFrame(rows, "k int")
    assert tuple(primary_key_check(frame, "k").first()) == (total, distinct, verdict)
    assert is_primary_key(frame, "k") is verdict


def test_composite_primary_key(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "b"), (1, None)], "k int, l string")
    assert is_primary_key(frame, ["k", "l"])
    assert not is_primary_key(frame, "k")
