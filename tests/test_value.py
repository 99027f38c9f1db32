import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsight import load_clean, read_table, stratified_split
from twinsight.operators import split as split_module
from twinsight.operators import value


def test_tiers_of_a_constant_are_all_zero(spark):
    df = spark.range(50).select(F.lit(5.0).alias("v"), (F.lit(5.0) + F.col("id") * 1e-9).alias("w"))
    for column in ("v", "w", None):
        assert df.select(value.tier_code_column(df, column)).distinct().count() == 1


def test_ties_at_a_cut_stay_below(spark):
    df = spark.createDataFrame([(x,) for x in [1.0] * 4 + [2.0] * 4 + [3.0] * 4], "v double")
    tiers = {r["v"]: r["tier"] for r in value.value_tiers(df, "v").collect()}
    q = np.quantile([1.0] * 4 + [2.0] * 4 + [3.0] * 4, [1 / 3, 2 / 3])
    assert tiers == {x: "high" if x > q[1] else "mid" if x > q[0] else "low" for x in (1.0, 2.0, 3.0)}


def test_bad_values_count_as_zero(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,), ("12d",), (" 7 ",)], "v string")
    assert [r[0] for r in df.select(value.value_vector(df, "v")).collect()] == [5.0, 0.0, 0.0, 0.0, 7.0]


def test_weights(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    heavy = df.select("v", value.weight_column(df, "v", factor=3.0).alias("w")).filter("w = 3.0")
    assert heavy.agg(F.min("v")).first()[0] == 91.0
    assert df.select(value.weight_column(df, None)).distinct().collect()[0][0] == 1.0


@pytest.mark.parametrize("keyed", [True, False])
def test_resample_has_the_expected_counts(spark, keyed):
    df = spark.range(20_000).withColumn("w", F.when(F.col("id") < 2_000, 2.0).otherwise(1.0))
    drawn = value.weighted_resample(df, "w", key=F.col("id") if keyed else None, seed=3)
    heavy, light = (drawn.filter(c).count() for c in ("id < 2000", "id >= 2000"))
    total = 2_000 * 2 + 18_000
    assert abs(heavy - 20_000 * 4_000 / total) < 5 * np.sqrt(4_000)
    assert abs(light - 20_000 * 18_000 / total) < 5 * np.sqrt(18_000)
    if keyed:
        assert sorted(drawn.collect()) == sorted(
            value.weighted_resample(df.repartition(7), "w", key=F.col("id"), seed=3).collect()
        )


def test_resample_of_one_heavy_row(spark):
    """A row with a third of all weight is drawn a third of the time."""
    df = spark.range(10_001).withColumn("w", F.when(F.col("id") == 0, 5_000.0).otherwise(1.0))
    drawn = value.weighted_resample(df, "w", key=F.col("id"))
    heavy = drawn.filter("id = 0").count()
    assert abs(heavy - 10_001 / 3) < 5 * np.sqrt(10_001 / 3)


def test_poisson_shape(spark):
    df = spark.range(60_000).withColumn("w", F.lit(1.0))
    counts = value.weighted_resample(df, "w", key=F.col("id")).groupBy("id").count().groupBy("count").count().collect()
    seen = {r[0]: r[1] / 60_000 for r in counts}
    for k, p in {1: 0.3679, 2: 0.1839, 3: 0.0613, 4: 0.0153}.items():
        assert seen[k] == pytest.approx(p, abs=0.01)


@pytest.mark.parametrize("bucket_rows", [1_000_000, 20])
def test_split_is_exact_and_whole(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(split_module, "_BUCKET_ROWS", bucket_rows)
    df = spark.range(3_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 100, None).otherwise((F.col("id") % 7).cast("string")).alias("s")
    )
    train, holdout = stratified_split(df, "s", "id", test_size=0.3)
    sizes = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    kept = {r["s"]: r["count"] for r in train.groupBy("s").count().collect()}
    assert kept == {s: int(np.ceil((1 - 0.3) * n)) for s, n in sizes.items()}
    assert sorted(train.union(holdout).collect()) == sorted(df.collect())
    other, _ = stratified_split(df, "s", "id", test_size=0.3, seed=1)
    assert sorted(other.select("id").collect()) != sorted(train.select("id").collect())


def test_csv_source_with_blanks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,total,churn\nA,12.5,Yes\nB, ,No\nC,,No\n")
    df = load_clean(read_table(spark, str(tmp_path / "c.csv")), ["id"], ["total"])
    assert df.columns == ["total", "churn"]
    assert [tuple(r) for r in df.collect()] == [(12.5, "Yes"), (0.0, "No"), (0.0, "No")]
