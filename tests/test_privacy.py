import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F
from test_neighbours import brute_force, table

from twinsight import (
    deployment_gate,
    membership_inference_auc,
    novelty_rate,
    ssf_score,
    three_axis_report,
)
from twinsight.operators.auc import roc_auc
from twinsight.operators.features import joint_encode, joint_space


def novelty(spark, real, synth, **options):
    return novelty_rate(spark.createDataFrame(real), spark.createDataFrame(synth), **options).first()[0]


def test_joint_space_rules(spark):
    left = spark.createDataFrame([(1, "a", 2.0, True)], "k int, c string, x double, only boolean")
    right = spark.createDataFrame([("1", 3.0, "z")], "k string, x double, c string")
    space = joint_space(left, right)
    assert (space.numeric, space.categorical) == (("x",), ("k", "c"))
    with pytest.raises(ValueError, match="in common"):
        joint_space(left.select("only"), right)
    holes = spark.createDataFrame([(None, None, float("nan"), None)], left.schema)
    row = joint_encode(holes, joint_space(holes, left)).first()
    assert row.asDict() == {"k": 0.0, "c": "None", "x": 0.0, "only": 0.0}


@pytest.mark.parametrize("ties", [False, True])
def test_auc_equals_the_mllib_evaluator(spark, ties):
    rng = np.random.default_rng(1)
    score = rng.normal(size=600)
    score = np.round(score, 1) + 0.0 if ties else score
    label = (rng.random(600) < 1 / (1 + np.exp(-score))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"s": score, "label": label}))
    counted = df.select("s", F.col("label").alias("p"), (1 - F.col("label")).alias("n"))
    want = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="label", numBins=0).evaluate(df)
    assert roc_auc(counted, "s", "p", "n").first()[0] == pytest.approx(want, abs=1e-12)


def test_auc_of_one_score_is_a_half(spark):
    df = spark.createDataFrame([(1.0, 3, 2)], "s double, p int, n int")
    assert roc_auc(df, "s", "p", "n").first()[0] == 0.5
    assert roc_auc(df.withColumn("n", F.lit(0)), "s", "p", "n").first()[0] is None


def test_auc_ranks_inside_parts(spark):
    """Scores are dealt by range; the only window over everything has a row per part."""
    df = spark.range(1000).select(F.rand(1).alias("s"), F.lit(1).alias("p"), F.lit(1).alias("n"))
    plan = roc_auc(df, "s", "p", "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") <= 2 and "_part" in plan


def test_membership_extremes(spark):
    a, b = (spark.createDataFrame(table(s, 150, "mixed")) for s in (1, 2))
    leaked = membership_inference_auc(a, a, b).first()[0]
    assert leaked > 0.95
    assert membership_inference_auc(a, b, a).first()[0] == pytest.approx(0.5)


def test_membership_equals_brute_force(spark):
    train, synth, holdout = (table(s, 120, "hot pivot") for s in (1, 2, 3))
    d = np.r_[brute_force(train, synth), brute_force(holdout, synth)].round(9)
    wins = (d[:120, None] < d[None, 120:]) + 0.5 * (d[:120, None] == d[None, 120:])
    got = membership_inference_auc(*(spark.createDataFrame(x) for x in (train, synth, holdout))).first()[0]
    assert got == pytest.approx(wins.mean(), abs=1e-9)


def test_novelty_extremes(spark):
    a = table(1, 200, "mixed")
    assert novelty(spark, a, a) == 0.0
    assert novelty(spark, a, a.assign(x=a["x"] + 1.0)) == pytest.approx((brute_force(a.assign(x=a["x"] + 1.0), a) > 1e-6).mean())


@pytest.mark.parametrize("tol", [0.0, 1e-6, 0.3, 1.5])
@pytest.mark.parametrize("shape", ["mixed", "hot pivot", "hot tuple", "categories", "clusters"])
def test_novelty_equals_brute_force(spark, shape, tol):
    """Twins at, just inside and just outside the tolerance, in one number and spread over two."""
    real = table(1, 200, shape)
    synth = pd.concat([table(2, 100, shape), real.head(150)], ignore_index=True)
    if "x" in synth:
        synth.loc[100:149, "x"] += tol * 0.999
        synth.loc[150:199, "x"] -= tol * 1.001
    want = (brute_force(synth, real) > tol).mean()
    assert novelty(spark, real, synth, tol=tol) == pytest.approx(want)


def test_novelty_on_grid_values(spark):
    """Whole and half numbers, where a careless grid would put every row on a border."""
    rng = np.random.default_rng(4)
    real = pd.DataFrame({"x": rng.integers(0, 40, 300) / 2, "y": rng.integers(0, 9, 300), "z": rng.integers(-3, 3, 300)})
    synth = pd.DataFrame({"x": rng.integers(0, 40, 300) / 2, "y": rng.integers(0, 9, 300), "z": rng.integers(-3, 3, 300)})
    for tol in (1e-6, 0.5):
        assert novelty(spark, real, synth, tol=tol) == pytest.approx((brute_force(synth, real) > tol).mean())


def test_novelty_of_large_numbers(spark):
    real = pd.DataFrame({"x": 1e12 + np.arange(50) * 1000.0, "c": ["a"] * 50})
    synth = pd.concat([real.head(20), real.tail(20).assign(x=lambda d: d["x"] + 1.0)])
    assert novelty(spark, real, synth) == 0.5


def test_novelty_plan_is_a_hash_join(spark):
    df = novelty_rate(spark.createDataFrame(table(1, 50, "mixed")), spark.createDataFrame(table(2, 50, "mixed")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_report_and_gate(spark):
    train, synth, holdout = (spark.createDataFrame(table(s, 150, "mixed")) for s in (1, 2, 3))
    report = three_axis_report(train, synth, holdout)
    row = report.first()
    assert report.columns == ["membership_inference_auc", "membership_inference_risk", "novelty_rate", "passes_privacy"]
    bands = [(0.55, "low (safe)"), (0.7, "moderate"), (2.0, "high (unsafe)")]
    assert row[1] == next(text for top, text in bands if row[0] < top)
    assert row[3] == (row[0] < 0.55 and row[2] > 0.99)
    fidelity = ssf_score(train, synth, F.lit(0.6), "x")
    gate = deployment_gate(report, fidelity.summary)
    assert gate.count() == 1 and {"ssf", "passes_privacy"} <= set(gate.columns)
