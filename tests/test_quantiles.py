import numpy as np
import pandas as pd
import pytest

from twinsight.operators import quantiles as q


def frame(spark, groups):
    rows = [pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()]
    return spark.createDataFrame(pd.concat(rows)).repartition(5)


CASES = {
    "smooth": lambda rng: rng.normal(size=3000),
    "hot value": lambda rng: np.where(rng.random(3000) < 0.4, 7.0, rng.random(3000) * 20),
    "two values": lambda rng: np.repeat([1.0, 2.0], [1000, 500]),
    "constant": lambda rng: np.full(500, 3.25),
    "one row": lambda rng: np.array([4.0]),
    "long tail": lambda rng: np.exp(rng.normal(size=3000) * 5),
}


@pytest.mark.parametrize("bracket", [20_000, 3])
def test_equal_to_numpy(spark, monkeypatch, bracket):
    monkeypatch.setattr(q, "BRACKET_VALUES", bracket)
    rng = np.random.default_rng(5)
    groups = {name: make(rng) for name, make in CASES.items()}
    probs = [0.0, 1 / 3, 2 / 3, 0.9, 1.0]
    got = q.exact_quantiles(frame(spark, groups), "v", probs, group="g")
    for name, values in groups.items():
        np.testing.assert_allclose(got[name], np.quantile(values, probs), rtol=1e-12, err_msg=name)


@pytest.mark.parametrize("accuracy_loss", [0.0, 0.2])
def test_survives_a_bad_sketch(spark, monkeypatch, accuracy_loss):
    """Brackets that miss their rank are found out by the counts and widened."""
    monkeypatch.setattr(q, "_SLACK", -accuracy_loss)
    values = np.random.default_rng(6).random(4000)
    got = q.exact_quantiles(frame(spark, {"a": values}), "v", [0.25, 0.5], group="g")
    np.testing.assert_allclose(got["a"], np.quantile(values, [0.25, 0.5]), rtol=1e-12)


def test_empty_input(spark):
    df = spark.createDataFrame([], "v double")
    assert q.exact_quantiles(df, "v", [0.5]) == {}
