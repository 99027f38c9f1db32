import pytest
from pyspark.sql import functions as F

from twinsight import TableEncoder
from twinsight.operators.encoder import indexed_levels
from twinsight.operators.profile import binarise, detect_labels, infer_column_kinds, label_text


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, float(i) / 2 if i % 5 else None, ["A", "B", None][i % 3], i % 2 == 0, f"name {i}") for i in range(1, 61)]
    return spark.createDataFrame(rows, "age int, score double, plan string, active boolean, name string")


def test_kinds(people):
    kinds = infer_column_kinds(people, target="plan")
    assert kinds == {"age": "numeric", "score": "numeric", "active": "categorical", "name": "text"}
    assert infer_column_kinds(people, max_cardinality=70)["name"] == "categorical"


def test_number_with_few_values_is_a_category(spark):
    df = spark.range(100).select((F.col("id") % 12).alias("a"), (F.col("id") % 13).alias("b"))
    assert infer_column_kinds(df) == {"a": "categorical", "b": "numeric"}


def test_free_text_is_left_out_with_a_warning(people):
    with pytest.warns(UserWarning, match="name"):
        encoder = TableEncoder.infer(people, target="plan")
    assert encoder.numeric == ["age", "score"] and encoder.categorical == ["active"]


def test_dates_are_refused(spark):
    with pytest.raises(TypeError, match="cast it"):
        infer_column_kinds(spark.sql("select date'2024-01-01' as d"))


def test_missing_number_is_midpoint_and_missing_text_a_level(people):
    encoder = TableEncoder(categorical=["plan"], numeric=["score"]).fit(people)
    assert encoder.category_state[0].levels == ("A", "B", "None") and encoder.dim == 4
    rows = encoder.transform(people).select("score", "plan", "features").collect()
    for score, plan, x in rows:
        if score is None:
            assert x[0] == pytest.approx(0.5)
        assert x[1:] == [float(plan == "A"), float(plan == "B"), float(plan is None)]


def test_unseen_level_takes_slot_0_and_range_is_not_clipped(spark, people):
    encoder = TableEncoder(["plan"], ["age"]).fit(people)
    other = spark.createDataFrame([(119, "Z"), (-58, "B")], "age int, plan string")
    got = [r[0] for r in encoder.transform(other).select("features").collect()]
    assert got == [[2.0, 1.0, 0.0, 0.0], [-1.0, 0.0, 1.0, 0.0]]


@pytest.mark.parametrize("levels", [1, 3, 90])
def test_one_hot_forms(spark, levels):
    """Short blocks are compiled comparisons, long ones a transform; both hold one 1."""
    df = spark.range(levels * 2).select((F.col("id") % levels).cast("string").alias("c"))
    encoder = TableEncoder(["c"]).fit(df)
    for c, x in encoder.transform(df).select("c", "features").collect():
        assert sum(x) == 1.0 and encoder.category_state[0].levels[x.index(1.0)] == c


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(3.0, "x"), (3.0, "y")], "flat double, junk string")
    encoder = TableEncoder(numeric=["flat"]).fit(df)
    assert [r[0] for r in encoder.transform(df).select("features").collect()] == [[0.0], [0.0]]
    with pytest.warns(UserWarning, match="no number"):
        junk = TableEncoder(numeric=["junk"]).fit(df)
    assert [r[0] for r in junk.transform(df).select("features").collect()] == [[0.0], [0.0]]


def test_decode_clips_rounds_half_even_and_breaks_ties_low(spark, people):
    encoder = TableEncoder(["plan"], ["age"]).fit(people)
    vectors = [[9.0, 0.2, 0.2, 0.1], [-1.0, 0.0, 0.0, 5.0], [1.5 / 59, 0.0, 1.0, 0.0]]
    df = spark.createDataFrame([(v,) for v in vectors], "features array<double>")
    assert [tuple(r) for r in encoder.inverse_transform(df).collect()] == [(60, "A"), (1, "None"), (2, "B")]


def test_round_trip_and_column_order(people):
    encoder = TableEncoder(["plan", "active"], ["age"]).fit(people)
    back = encoder.inverse_transform(encoder.transform(people))
    assert back.columns == ["age", "plan", "active"]
    want = {(r["age"], r["plan"] or "None", str(r["active"])) for r in people.collect()}
    assert {tuple(r) for r in back.collect()} == want


def test_state_survives_saving(spark, people, tmp_path):
    encoder = TableEncoder(["plan"], ["age", "score"]).fit(people)
    encoder.save(spark, str(tmp_path / "state"))
    loaded = TableEncoder.load(spark, str(tmp_path / "state"))
    assert loaded.numeric_state == encoder.numeric_state and loaded.category_state == encoder.category_state


def test_double_levels_read_like_plain_decimals(spark):
    df = spark.createDataFrame([(1e7,), (0.0005,), (2.5,), (float("nan"),), (None,), (123456789.125,)], "x double")
    levels = TableEncoder(["x"]).fit(df).category_state[0].levels
    assert set(levels) == {"10000000.0", "0.0005", "2.5", "nan", "123456789.125"}


def test_indexed_levels_are_in_text_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("B",), ("10",), ("9",)], "c string")
    got = {r["level"]: r["index"] for r in indexed_levels(df, ["c"]).collect()}
    assert got == {"10": 0, "9": 1, "B": 2, "a": 3, "b": 4}


@pytest.mark.parametrize(
    "values, negative, positive",
    [
        (["Yes", "No"], "No", "Yes"),
        (["Yes"], "No", "Yes"),
        (["1", "0", "2"], "0", "1"),
        (["true", "Yes", "a"], "a", "Yes"),
        (["b", "a"], "a", "b"),
        (["c", "a", "b"], "a", "c"),
        (["x"], "x", "x"),
    ],
)
def test_labels(spark, values, negative, positive):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    pair = detect_labels(df, "t")
    assert (pair.negative, pair.positive) == (negative, positive)
    back = df.select("t", label_text(binarise(df, "t", pair), pair).alias("b")).collect()
    assert all((r["b"] == positive) == (r["t"] == positive) for r in back)


def test_boolean_and_integer_targets(spark):
    flags = spark.createDataFrame([(True,), (False,)], "t boolean")
    assert detect_labels(flags, "t").positive == "True"
    numbers = spark.createDataFrame([(0,), (1,)], "t int")
    assert detect_labels(numbers, "t") == detect_labels(numbers.selectExpr("cast(t as string) t"), "t")
