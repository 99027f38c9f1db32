import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinsight import CampaignEconomics, Strategy, default_strategy_family, ssf_score
from twinsight.operators import ssf


def population(seed, n=400, scale=1.0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"value": rng.uniform(20, 120, n) * scale, "prob": rng.random(n)})


def loop_roi(pdf, family, econ):
    """The definition, one strategy at a time."""
    t1, t2 = np.quantile(pdf["value"], [1 / 3, 2 / 3])
    tier = np.select([pdf["value"] > t2, pdf["value"] > t1], ["high", "mid"], "low")
    out = []
    for s in family:
        at = (pdf["prob"] >= s.threshold) & ((tier == s.segment) | (s.segment == "all"))
        p, v = pdf["prob"][at], pdf["value"][at]
        saved = (p * v).sum() * econ.value_recoverable * econ.success_rate * (1 - s.discount)
        wasted = ((1 - p) * v).sum() * s.discount * econ.fp_redemption
        out.append(saved - wasted - at.sum() * econ.retention_offer_cost)
    return np.array(out)


def check(spark, real, synth, family, econ):
    result = ssf_score(
        spark.createDataFrame(real), spark.createDataFrame(synth), F.col("prob"), "value", family, econ
    )
    want = {s: (a, b) for s, a, b in zip(family, loop_roi(real, family, econ), loop_roi(synth, family, econ))}
    rows = result["per_strategy"]
    assert len(rows) == len(family)
    for r in rows:
        a, b = want[Strategy(r["segment"], r["discount"], r["threshold"])]
        np.testing.assert_allclose([r["roi_real"], r["roi_syn"]], [a, b], rtol=1e-9, atol=1e-9)
        assert (r["decision_real"], r["decision_syn"], r["agree"]) == (int(a > 0), int(b > 0), (a > 0) == (b > 0))
    pairs = [want[s] for s in family]
    agree = [(a > 0) == (b > 0) for a, b in pairs]
    assert result["ssf"] == pytest.approx(np.mean(agree))
    assert (result["n_strategies"], result["n_agree"]) == (len(family), sum(agree))
    gap = np.mean([abs(a - b) / max(abs(a), 1.0) for a, b in pairs]) * 100
    assert result["mean_roi_gap_pct"] == pytest.approx(gap, rel=1e-9)


def test_default_grid(spark):
    family = default_strategy_family()
    assert len(family) == 48 and family[0] == Strategy("high", 0.05, 0.30)
    check(spark, population(1), population(2, scale=0.7), family, CampaignEconomics(3.0))


@pytest.mark.parametrize("count", [7, 90])
def test_own_family_with_repeats(spark, count):
    """Few thresholds take the compiled chain, many the bucket search; repeats keep their weight."""
    rng = np.random.default_rng(3)
    family = [
        Strategy(str(rng.choice(["high", "mid", "low", "all", "nobody"])), float(d), float(t))
        for d, t in rng.random((count, 2))
    ]
    check(spark, population(4), population(5, scale=1.2), family + family[:3], CampaignEconomics(2.0, 0.4, 0.5, 0.2))


def test_many_thresholds_on_the_scores_themselves(spark):
    """Thresholds equal to scores, most customers on one score, NaN and missing scores, thresholds above all scores."""
    real, synth = population(20), population(21, scale=1.1)
    for frame in (real, synth):
        frame["prob"] = (frame["prob"] * 200).round() / 200
        frame.loc[:150, "prob"] = 0.5
        frame.loc[380:, "prob"] = np.nan
    family = [Strategy(segment, 0.1, t / 200) for t in range(0, 220, 2) for segment in ("all", "mid")]
    check(spark, real, synth, family, CampaignEconomics(2.0))


def test_a_missing_threshold_flags_nobody(spark):
    df = spark.createDataFrame(population(22))
    for count in (3, 100):
        rows = [("all", 0.1, float(i) / count) for i in range(count)] + [("all", 0.1, None), ("high", 0.2, float("nan"))]
        family = spark.createDataFrame(rows, "segment string, discount double, threshold double")
        got = {str(r["threshold"]): r["roi_real"] for r in ssf_score(df, df, F.col("prob"), "value", family).per_strategy.collect()}
        assert len(got) == count + 2 and got["None"] == got["nan"] == 0.0 and got["0.0"] != 0.0


def test_family_of_many_thresholds_stays_off_the_driver(spark):
    """No list of thresholds in the plan, no join but by key."""
    df = spark.createDataFrame(population(23))
    family = spark.range(3000).select(F.lit("all").alias("segment"), F.lit(0.1).alias("discount"), (F.col("id") / 3000).alias("threshold"))
    compared = ssf_score(df, df, F.col("prob"), "value", family).compared
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "CASE WHEN (prob" not in plan
    assert compared.count() == 3000


def test_same_population_agrees_fully(spark):
    df = spark.createDataFrame(population(7))
    result = ssf_score(df, df, F.col("prob"), "value")
    assert result["ssf"] == 1.0 and result["mean_roi_gap_pct"] < 1e-9


def test_empty_family_means_the_default_grid(spark):
    df = spark.createDataFrame(population(7))
    assert ssf_score(df, df, F.col("prob"), "value", strategy_family=[])["n_strategies"] == 48


def test_saturated_economics_are_flagged(spark):
    df = spark.createDataFrame(population(7))
    costly = ssf_score(df, df, F.col("prob"), "value", econ=CampaignEconomics(1e6))
    assert costly["n_go_real"] == 0 and costly["is_discriminating"] is False


def test_nan_scores_are_never_flagged(spark):
    real = population(8)
    real.loc[::3, "prob"] = np.nan
    check(spark, real, population(9), default_strategy_family(), CampaignEconomics(1.0))


def test_missing_value_raises_or_is_dropped(spark):
    holes = population(10)
    holes.loc[5, "value"] = np.nan
    df, whole = spark.createDataFrame(holes), spark.createDataFrame(holes.dropna())
    with pytest.raises(Exception, match="missing values"):
        ssf_score(df, df, F.col("prob"), "value")["ssf"]
    dropped = ssf_score(df, df, F.col("prob"), "value", on_missing="drop").per_strategy
    assert sorted(dropped.collect()) == sorted(ssf_score(whole, whole, F.col("prob"), "value").per_strategy.collect())


def test_text_value_raises(spark):
    df = spark.createDataFrame([("12", 0.5), ("many", 0.5)], "value string, prob double")
    with pytest.raises(Exception, match="many"):
        ssf_score(df, df, F.col("prob"), "value")["ssf"]


def test_scorer_forms_agree(spark):
    df = spark.createDataFrame(population(11))
    column = F.col("prob") / 2
    as_function = ssf_score(df, df, lambda d: d["prob"] / 2, "value").per_strategy.collect()
    as_table = ssf_score(df, df, lambda d: d.withColumn("prob", F.col("prob") / 2), "value").per_strategy.collect()
    as_column = ssf_score(df, df, column, "value").per_strategy.collect()
    assert sorted(as_function) == sorted(as_table) == sorted(as_column)


def test_one_aggregate_over_the_customers(spark):
    """However many strategies: one pass over each population behind one small shuffle."""
    df = spark.createDataFrame(population(12))
    plan = ssf_score(df, df, F.col("prob"), "value").compared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(population") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tiers_use_each_population(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("b", float(i) * 100) for i in range(9)], "population string, value double")
    tiers = ssf.add_tiers(rows).groupBy("population", "tier").count().collect()
    assert {r["count"] for r in tiers} == {3}
