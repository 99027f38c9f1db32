"""What the physical plans must and must not hold at any scale."""

import re
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from twinsight import TableEncoder, novelty_rate, ssf_score, stratified_split
from twinsight.functions.frames import materialise, merge_one_row_frames, release, shared_folder
from twinsight.operators import quantiles, value
from twinsight.operators.ssf import add_tiers, score_population
from twinsight.plans import stand_ins as st
from twinsight.plans.catalog import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(plan):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, data, name):
    if name == "score_gbt":
        pytest.skip("trains a model")
    plan = plan_of(QUERIES[name](spark, data))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_fidelity_reads_two_columns_once_per_population(spark, data):
    result = ssf_score(st.line_values(spark, data), st.line_values(spark, data, 0.8), st.line_scorer(), "value")
    assert read_columns(plan_of(result.compared)) == [{"l_quantity", "l_extendedprice"}] * 2


def test_a_result_is_settled_once(spark, data):
    """Scalars, summary and strategies all come from the rows written at the first read."""
    result = ssf_score(st.line_values(spark, data), st.line_values(spark, data, 0.8), st.line_scorer(), "value")
    assert 0 <= result["ssf"] <= 1
    for df in (result.summary, result.per_strategy):
        assert "lineitem" not in plan_of(df) and "/tables/" in df.inputFiles()[0]


def test_materialised_tables_can_be_removed(spark):
    written = materialise(spark.range(5))
    file = Path(urlparse(written.inputFiles()[0]).path)
    assert file.exists()
    release(spark)
    assert not file.parent.exists()


def test_tiers_need_the_value_column_only(spark, data):
    rows = score_population(st.line_values(spark, data), st.line_scorer(), "value", "real")
    grouped = rows.groupBy("population").agg(F.percentile_approx("value", [0.3], 100))
    assert read_columns(plan_of(grouped)) == [{"l_extendedprice"}]
    assert "Exchange" not in plan_of(add_tiers(rows))


def test_encoding_needs_no_shuffle_join_or_python(spark, data):
    lines = st.labelled_lines(spark, data)
    encoder = TableEncoder(["l_linenumber", "l_linestatus"], ["l_quantity"]).fit(lines)
    plan = plan_of(encoder.transform(lines).select("features"))
    for bad in ("Exchange", "Join", "Python"):
        assert bad not in plan
    assert read_columns(plan) == [{"l_linenumber", "l_linestatus", "l_quantity"}]


def test_resampling_needs_no_shuffle(spark, data):
    rows = st.table(spark, data, "customer").withColumn("w", F.lit(1.0))
    assert "Exchange" not in plan_of(value.weighted_resample(rows, "w", key=F.col("c_custkey")))


def test_split_is_a_filter(spark, data):
    train, _ = stratified_split(st.table(spark, data, "orders"), "o_orderstatus", "o_orderkey")
    plan = plan_of(train)
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_filters_reach_the_scan(spark, data):
    real, synth = st.order_pair(spark, data)
    plan = plan_of(ssf_score(real.filter("o_orderstatus = 'F'"), synth, F.lit(0.5), "o_totalprice").compared)
    assert "EqualTo(o_orderstatus,F)" in plan


def test_novelty_shuffles_distinct_rows_only(spark, data):
    """Copies are merged before each shuffle of the rows."""
    plan = plan_of(novelty_rate(*st.order_pair(spark, data)))
    scans, partial = plan.count("FileScan"), plan.count("HashAggregate")
    assert scans == 3 and partial >= 6


def test_shared_folder_is_the_one_the_cluster_names(spark):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: f"named by {key}"))
    assert shared_folder(named) == "named by spark.checkpoint.dir"
    unset = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(unset)
    written = materialise(spark.range(5))
    assert written.count() == 5 and f"{shared_folder(spark)}/tables/" in written.inputFiles()[0].replace("file://", "file:")


def test_merging_one_row_frames(spark):
    a, b = spark.sql("select 1 as x, 'u' as t"), spark.sql("select true as ok")
    assert merge_one_row_frames(a, b).first().asDict() == {"x": 1, "t": "u", "ok": True}


def test_large_quantiles_never_gather_the_column(spark, data, monkeypatch):
    """No exact percentile (a map of all values in one task) is used at any size."""
    monkeypatch.setattr(quantiles.F, "percentile", None)
    lines = st.table(spark, data, "lineitem")
    assert quantiles.exact_quantiles(lines, "l_extendedprice", [0.5])[""]
