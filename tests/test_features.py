import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import plan_of
from oddsmith.functions import code_of, flag_positive, flag_true, keep_listed, literal
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

NAN = float("nan")


def values(df, expression):
    return [r[0] for r in df.select(F.expr(expression)).collect()]


def test_flags(spark):
    numbers = spark.createDataFrame([(3.0,), (0.0,), (-1.0,), (None,), (NAN,)], "x double")
    assert values(numbers, flag_positive("x")) == [1, 0, 0, 0, 0]
    truths = spark.createDataFrame([(True,), (False,), (None,)], "x boolean")
    assert values(truths, flag_true("x")) == [1, 0, 0]
    ints = spark.createDataFrame([(3,), (0,), (None,)], "x int")
    assert values(ints, flag_positive("x")) == [1, 0, 0]


def test_categories_and_codes(spark):
    frame = spark.createDataFrame([("M",), ("F",), ("X",), (None,), ("m",)], "x string")
    assert values(frame, keep_listed("x", ["M", "F"])) == ["M", "F", "other", "other", "other"]
    assert values(frame, code_of("x", {"M": 0, "F": 1}, 2)) == [0, 1, 2, 2, 2]


@pytest.mark.parametrize("text", ["it's", "back\\slash", 'quote"', "new\nline", "`tick`", "%s"])
def test_literals(spark, text):
    assert spark.sql(f"SELECT {literal(text)}").first()[0] == text


def test_float_literals(spark):
    for value in (1e-9, -2.5, 1e22, 250562.6413373334):
        assert spark.sql(f"SELECT {literal(value)}").first()[0] == value


@pytest.fixture
def people(spark):
    rows = [
        (1, 1.0, 2, True, "M", "Chrome", "exact match", "train"),
        (2, 3.0, 0, False, "F", "Edge", "close match", "train"),
        (3, None, None, None, None, None, None, "train"),
        (4, NAN, -4, True, "F", "Chrome", "no", "train"),
        (5, 50.0, 9, False, "M", "Opera", "exact match", "val"),
        (6, None, 1, None, "Q", None, "x", "val"),
    ]
    return spark.createDataFrame(
        rows,
        "id int, f double, i int, b boolean, gender string, browser string, email string, "
        "split string",
    )


BRANCHES = [
    MeanImpute(["f"]),
    PositiveFlag(["i"]),
    TrueFlag(["b"]),
    KeepList("gender", ["M", "F"]),
    KeepList("browser", ["Chrome"]),
    CodeMap("email", {"exact match": 0, "close match": 1}, 2),
]


def test_matrix(people):
    model = FeatureEncoder(BRANCHES).fit(people.filter("split = 'train'"))
    assert feature_names(model) == [
        "f",
        "i",
        "b",
        "gender_F",
        "gender_M",
        "gender_other",
        "browser_other",
        "email_0",
        "email_1",
        "email_2",
    ]
    rows = model.transform(people).select("id", vector_to_array("features").alias("v")).collect()
    # The mean of 1 and 3 is learned on train rows only and leaves out NaN.
    assert {r["id"]: r["v"] for r in rows} == {
        1: [1, 1, 1, 0, 1, 0, 0, 1, 0, 0],
        2: [3, 0, 0, 1, 0, 0, 1, 0, 1, 0],
        3: [2, 0, 0, 0, 0, 1, 1, 0, 0, 1],
        4: [2, 0, 1, 1, 0, 0, 0, 0, 0, 1],
        5: [50, 1, 0, 0, 1, 0, 1, 1, 0, 0],
        6: [2, 1, 0, 0, 0, 1, 1, 0, 0, 1],
    }


def test_saved_encoder(people, tmp_path):
    model = FeatureEncoder(BRANCHES).fit(people)
    model.save(str(tmp_path / "encoder"))
    loaded = PipelineModel.load(str(tmp_path / "encoder"))
    assert feature_names(loaded) == feature_names(model)
    same = [m.transform(people).select("id", "features").collect() for m in (model, loaded)]
    assert same[0] == same[1]


def test_encoding_is_one_projection_over_a_pruned_scan(table):
    orders = table("orders")
    model = FeatureEncoder([MeanImpute(["o_totalprice"]), Categories("o_orderpriority")]).fit(orders)
    plan = plan_of(model.transform(orders).select("features"))
    assert "Exchange" not in plan and "EvalPython" not in plan
    schema = plan[plan.index("ReadSchema") :]
    assert "o_custkey" not in schema and "o_orderstatus" not in schema


def test_exactly_two_categories_make_one_column(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    model = FeatureEncoder([Categories("c")]).fit(frame)
    assert feature_names(model) == ["c_b"]
    assert [r[0] for r in model.transform(frame).select("x_c_b").collect()] == [1, 0, 1]


def test_missing_is_a_category(spark):
    frame = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    model = FeatureEncoder([Categories("c")]).fit(frame)
    assert feature_names(model) == ["c_a", "c_b", "c_None"]
    assert [tuple(r) for r in model.transform(frame).select("x_c_None", "x_c_a").collect()] == [
        (0, 0),
        (0, 1),
        (1, 0),
    ]


@pytest.mark.parametrize("branch", [Categories("c"), KeepList("c", ["a", "b"])])
def test_unseen_category(spark, branch):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    later = spark.createDataFrame([("z",), (None,)], "c string")
    strict = FeatureEncoder([branch]).fit(train)
    with pytest.raises(Exception, match="not seen in the train rows"):
        strict.transform(later).select("features").collect()
    loose = FeatureEncoder([branch], handle_unknown="ignore").fit(train)
    vectors = loose.transform(later).select(vector_to_array("features")).collect()
    assert [r[0] for r in vectors] == [[0.0], [0.0]]


def test_a_column_without_numbers_is_left_out(spark):
    frame = spark.createDataFrame([(None, 1.0), (NAN, 2.0)], "a double, b double")
    assert feature_names(FeatureEncoder([MeanImpute(["a", "b"])]).fit(frame)) == ["b"]
    with pytest.raises(ValueError):
        FeatureEncoder([MeanImpute(["a"])]).fit(frame)


def test_too_many_categories(spark):
    with pytest.raises(ValueError, match="more than 10"):
        FeatureEncoder([Categories("c", limit=10)]).fit(
            spark.range(11).select(F.col("id").cast("string").alias("c"))
        )


def test_wide_categories(spark, tmp_path):
    frame = spark.range(3000).selectExpr("IF(id = 7, NULL, concat('v', id % 1500)) AS c", "id AS x")
    encoder = FeatureEncoder([Categories("c", wide=True), MeanImpute(["x"])], handle_unknown="ignore")
    encoder.save(str(tmp_path / "encoder"))
    model = FeatureEncoder.load(str(tmp_path / "encoder")).fit(frame)
    names = feature_names(model)
    assert len(names) == 1502 and names[0].endswith("_None") and names[-1] == "x"
    vector = model.transform(frame.filter("x = 20")).first()["features"]
    assert vector.numNonzeros() == 2 and vector[names.index("_category_0_v20")] == 1.0
    unseen = spark.createDataFrame([("new", 1)], "c string, x long")
    assert model.transform(unseen).first()["features"].numNonzeros() == 1
    with pytest.raises(Exception):
        FeatureEncoder([Categories("c", wide=True)]).fit(frame).transform(unseen).collect()


def test_odd_names_and_values(spark):
    frame = spark.createDataFrame([("a.b",), ("it's",), ("c`d",)], "`odd name` string")
    model = FeatureEncoder([Categories("odd name")]).fit(frame)
    assert feature_names(model) == ["odd name_a_b", "odd name_c_d", "odd name_it's"]
    total = model.transform(frame).select(F.aggregate(
        vector_to_array("features"), F.lit(0.0), lambda a, b: a + b)).collect()
    assert [r[0] for r in total] == [1.0, 1.0, 1.0]


def test_names_must_differ(spark):
    frame = spark.createDataFrame([("a.b", 1.0), ("a_b", 2.0)], "c string, d double")
    with pytest.raises(ValueError, match="taken"):
        FeatureEncoder([Categories("c"), Categories("c")]).fit(frame)


def test_integer_categories(spark):
    frame = spark.createDataFrame([(10,), (2,), (3,)], "c int")
    assert feature_names(FeatureEncoder([Categories("c")]).fit(frame)) == ["c_2", "c_3", "c_10"]


def test_float_means_are_exact_literals(spark):
    frame = spark.createDataFrame([(0.1,), (0.2,), (None,)], "x double")
    model = FeatureEncoder([MeanImpute(["x"])]).fit(frame)
    found = [r[0] for r in model.transform(frame).select("x_x").collect()]
    assert math.isclose(found[2], 0.15, rel_tol=1e-15)


def test_encoders_without_a_fold_equal_refits(spark):
    """Means, kept values and categories; one fold has a value of its own."""
    rows = [(i, float(i * i % 17) if i % 3 else None, ["a", "b", "only"][2 if i % 40 == 0 else i % 2], i % 4 if i else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, c string, fold int").withColumn("d", F.col("c"))
    encoder = FeatureEncoder([MeanImpute(["x"]), KeepList("c", ["a", "only"]), Categories("d")], handle_unknown="ignore")
    for fold, model in enumerate(encoder.fit_without(df, "fold", 4)):
        others = df.where(~F.col("fold").eqNullSafe(fold)).drop("fold")
        again = encoder.fit(others)
        assert feature_names(model) == feature_names(again)
        mine, theirs = ([r["features"].toArray().round(9).tolist() for r in m.transform(df).orderBy("id").collect()] for m in (model, again))
        assert mine == theirs


def test_encoders_without_a_fold_take_the_passes_of_one_fit(spark):
    df = spark.range(100).selectExpr("id", "id * 1D AS x", "int(id % 4) AS fold")
    calls = []
    kind = type(df)
    own = kind.collect
    kind.collect = lambda self: (calls.append(1), own(self))[1]
    try:
        FeatureEncoder([MeanImpute(["x"])]).fit_without(df, "fold", 4)
    finally:
        kind.collect = own
    assert len(calls) == 1


def test_named_categories_are_bounded(spark):
    df = spark.range(1_001).selectExpr("id", "string(id) AS c")
    with pytest.raises(ValueError, match="more than 1000"):
        FeatureEncoder([Categories("c")]).fit(df)
    assert FeatureEncoder([Categories("c", wide=True)]).fit(df) is not None
