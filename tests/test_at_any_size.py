"""Exact draws, apportioned splits, many levels, many groups, many candidates: against brute force on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinsight.functions import frames
from twinsight.functions.frames import materialise, own_tables, release, rows_in_order, running_sums, sums_before
from twinsight.operators import value
from twinsight.operators.encoder import TableEncoder
from twinsight.operators.quantiles import group_quantiles
from twinsight.operators.sparse import SparseEncoder
from twinsight.operators.split import stratified_split
from twinsight.operators.ssf import compare_by_key, compare_candidates


def test_sums_before_in_any_partitioning(spark):
    rng = np.random.default_rng(1)
    table = pd.DataFrame({"k": rng.permutation(500), "x": rng.integers(0, 9, 500)})
    for parts in (1, 7):
        df = spark.createDataFrame(table).repartition(parts)
        got = sums_before(df, [F.col("k").desc()], F.col("x"), "sum").toPandas().sort_values("k", ascending=False)
        assert got["sum"].tolist() == [0, *got["x"].cumsum().tolist()[:-1]]
        ranks = rows_in_order(df, [F.col("k")]).toPandas()
        assert (ranks["rank"] == ranks["k"]).all()
    assert rows_in_order(df.limit(0), [F.col("k")]).count() == 0


def folders():
    return [p for scope in frames._SCOPES for p in scope]


def test_tables_go_with_their_scope(spark):
    before = folders()
    with own_tables(spark) as outer:
        inner = materialise(spark.range(10))
        assert inner.count() == 10
        with own_tables(spark) as nested:
            kept_inside = nested.keep(inner.filter("id > 3"))
        kept = outer.keep(kept_inside.filter("id > 5"))
    assert kept.count() == 4 and len(folders()) == len(before) + 1
    from pathlib import Path

    held = {p.name for p in (Path(frames.shared_folder(spark).removeprefix("file:")) / "tables").iterdir()}
    gone = [inner, kept_inside]
    assert Path(folders()[-1]).name in held and not any(Path(t.inputFiles()[0]).parent.name in held for t in gone)
    with pytest.raises(ZeroDivisionError), own_tables(spark):
        materialise(spark.range(3))
        1 / 0
    assert len(folders()) == len(before) + 1


def test_release_empties_the_folder(spark):
    from pathlib import Path

    materialise(spark.range(3)).count()
    written = folders()
    release(spark)
    assert folders() == [] and not any(Path(p.removeprefix("file:")).exists() for p in written)


def drawn(df, n, **options):
    rows = value.exact_resample(df, "w.t", n, F.col("k"), **options)
    return rows.groupBy("k").count().toPandas().set_index("k")["count"].to_dict()


def test_exact_draws_on_any_partitioning(spark, monkeypatch):
    weights = [0.0, None, math.nan, -3.0, 500.0, *[1.0 + i % 3 for i in range(400)]]
    df = spark.createDataFrame([(i, w, "x") for i, w in enumerate(weights)], "k long, `w.t` double, row string")
    counts = drawn(df, 20_000)
    assert sum(counts.values()) == 20_000 and not counts.keys() & {0, 1, 2, 3}
    total = np.nansum([w for w in weights if w and w > 0])
    for k, c in counts.items():
        mean = 20_000 * weights[k] / total
        assert abs(c - mean) < 6 * math.sqrt(mean) + 1
    chi = sum((counts.get(k, 0) - 20_000 * w / total) ** 2 / (20_000 * w / total) for k, w in enumerate(weights) if w and w > 0)
    assert 300 < chi < 520  # 400 degrees of freedom
    monkeypatch.setattr(value, "_CELL_DRAWS", 300)
    monkeypatch.setattr(value, "_BUCKET_ROWS", 5)
    again = drawn(df.repartition(5), 20_000)
    assert again == counts
    assert drawn(df, 20_000, seed=9) != counts
    assert drawn(df, 0) == {} and drawn(df.filter("k < 4"), 5) == {} and drawn(df.limit(0), 5) == {}


@pytest.mark.parametrize("test_size", [0.3, 0.5, 0.07])
def test_split_totals(spark, test_size):
    rng = np.random.default_rng(2)
    strata = [None if x == 0 else f"s{x}" for x in rng.geometric(0.05, 700) - 1]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strata)], "k long, s string")
    train, rest = stratified_split(df, "s", "k", test_size=test_size, overall=True)
    n_rest = math.ceil(test_size * 700 - 1e-9)
    assert (train.count(), rest.count()) == (700 - n_rest, n_rest)
    sizes = pd.Series([s or "~" for s in strata]).value_counts()
    exact = sizes * (700 - n_rest) / 700
    left = 700 - n_rest - int(np.floor(exact + 1e-9).sum())
    order = sorted(sizes.index, key=lambda s: (-(sizes[s] * (700 - n_rest) % 700), s))
    want = {s: int(exact[s] + 1e-9) + (order.index(s) < left) for s in sizes.index}
    got = {r["s"] or "~": r["count"] for r in train.groupBy("s").count().collect()}
    assert got == {s: n for s, n in want.items() if n}


def test_sparse_rows_equal_dense_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()) if i % 7 else None, f"l{rng.integers(40)}" if i % 11 else None, int(rng.integers(5))) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, `x.y` double, `c d` string, slot int")
    dense = TableEncoder(["c d", "slot"], ["x.y"]).fit(df)
    sparse = SparseEncoder(["c d", "slot"], ["x.y"]).fit(df)
    assert sparse.dim == dense.dim
    moved = df.withColumn("c d", F.when(F.col("k") % 5 == 0, "unseen").otherwise(F.col("c d")))
    want = {r["k"]: r["f"] for r in dense.transform(moved, "f").collect()}
    for r in sparse.transform(moved).collect():
        full = np.zeros(dense.dim)
        full[r["slots"]] = r["values"]
        assert r["slots"] == sorted(r["slots"]) and np.allclose(full, want[r["k"]])
    back = {r["k"]: r for r in sparse.inverse_transform(sparse.transform(moved), keep=["k"]).collect()}
    for r in dense.inverse_transform(dense.transform(moved, "f"), "f", keep=["k"]).collect():
        assert back[r["k"]]["c d"] == r["c d"] and back[r["k"]]["slot"] == r["slot"]
        assert back[r["k"]]["x.y"] == pytest.approx(r["x.y"], abs=1e-6)


@pytest.mark.parametrize("cells", [[], [(1, 0.5), (2, 0.5)], [(1, -1.0)], [(1, -1.0), (2, -0.5), (3, -0.25)], [(2, -1.0), (3, 0.25)], [(1, -1.0), (3, 0.0)], [(1, -0.5), (2, -1.0)]])
def test_sparse_argmax_is_the_dense_one(spark, cells):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "c string, x double")
    fitted = SparseEncoder(["c"], ["x"]).fit(df)
    held = spark.createDataFrame([([s for s, _ in cells], [v for _, v in cells])], "slots array<long>, values array<float>")
    full = np.zeros(4)
    for s, v in cells:
        full[s] = v
    assert fitted.inverse_transform(held).first()["c"] == "abc"[int(full[1:].argmax())]


def test_quantiles_of_many_groups(spark):
    rng = np.random.default_rng(4)
    groups = [None if g == 0 else f"g{g}" for g in np.minimum(rng.geometric(0.02, 3000), 90) - 1]
    values = [None if i % 50 == 0 else math.nan if i % 51 == 0 else float(np.round(rng.normal(), 1)) for i in range(3000)]
    values = [7.0 if i % 3 == 0 and v is not None else v for i, v in enumerate(values)]  # a hot value
    df = spark.createDataFrame(list(zip(groups, values)), "`g.h` string, v double")
    probs = [0.0, 1 / 3, 0.5, 0.9, 1.0]
    got = {r["g.h"]: (r["n"], r["q"]) for r in group_quantiles(df, "v", probs, "g.h", "q").collect()}
    held = {}
    for g, v in zip(groups, values):
        if v is not None and not math.isnan(v):
            held.setdefault(g, []).append(v)
    assert got.keys() == held.keys()
    for g, v in held.items():
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, probs), rtol=1e-12)


def test_candidates_by_key_equal_candidates_by_name(spark):
    rng = np.random.default_rng(5)
    real = spark.createDataFrame(pd.DataFrame({"x": rng.random(400), "v": rng.gamma(2, 900, 400)}))
    names = ["real", "null", "a", None]
    frames_ = {n: pd.DataFrame({"x": rng.random(60 + 20 * i), "v": rng.gamma(2, 700, 60 + 20 * i)}) for i, n in enumerate(names)}
    keyed = [(n, *row) for n, f in frames_.items() for row in f.itertuples(index=False)]
    stacked = spark.createDataFrame([(n, float(x), float(v)) for n, x, v in keyed], "`can.didate` string, x double, v double")
    by_key = compare_by_key(real, stacked, "can.didate", F.col("x"), "v").toPandas()
    by_name = compare_candidates(real, {f"c_{n}": spark.createDataFrame(f) for n, f in frames_.items()}, F.col("x"), "v").toPandas()
    by_key["candidate"] = "c_" + by_key["candidate"].fillna("None").astype(str)
    key = ["candidate", "segment", "discount", "threshold"]
    both = by_key.merge(by_name, on=key, suffixes=("", "_want"))
    assert len(both) == len(by_name) == len(by_key) == 4 * 48
    for c in ("roi_real", "roi_syn", "roi_gap"):
        np.testing.assert_allclose(both[c], both[f"{c}_want"], rtol=1e-9, atol=1e-9)
    assert (both["agree"] == both["agree_want"]).all()


def test_plan_by_key_does_not_grow(spark):
    real = spark.range(50).select((F.col("id") / 50).alias("x"), (F.col("id") * 100.0).alias("v"))

    def size(n):
        many = spark.range(1000).select((F.col("id") % n).alias("c"), F.rand(1).alias("x"), (F.col("id") * 1.0).alias("v"))
        return len(compare_by_key(real, many, "c", F.col("x"), "v")._jdf.queryExecution().analyzed().toString().splitlines())

    assert size(2) == size(400)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_of_groups_across_parts(spark, parts):
    """One group holds most rows and spans parts; the sums restart with each group."""
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"g": np.where(rng.random(900) < 0.8, "hot", rng.choice(list("abc"), 900)), "at": rng.permutation(900), "n": rng.integers(-5, 9, 900)})
    want = rows.sort_values("at", ascending=False).groupby("g")["n"].cumsum()
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = running_sums(spark.createDataFrame(rows), ["g"], [F.desc("at")], ["n"]).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.set_index("at")["n"].to_dict() == dict(zip(rows["at"], want.reindex(rows.index)))


def test_a_group_of_most_rows_is_dealt_to_many_tasks(spark, monkeypatch):
    """Rows of a large group meet what belongs to it in many parts, null groups too, and nothing is lost."""
    monkeypatch.setattr(frames, "HEAVY_ROWS", 300)
    g = F.when(F.col("id") % 2 == 0, "large").when(F.col("id") % 20 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 50))
    rows = spark.range(8_000).select("id", g.alias("g"))
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    kept = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(kept[0], "false")
    spark.conf.set(kept[1], "-1")
    try:
        met = frames.join_by_group(rows, groups.filter("g IS NULL OR g <> 's3'"), "g", F.col("id"), ["most", "n"]).withColumn("part", F.spark_partition_id()).toPandas()
    finally:
        for c in kept:
            spark.conf.unset(c)
    want = rows.toPandas().merge(groups.toPandas(), on="g").query("g != 's3'")  # pandas matches nulls
    assert len(want) == len(met) and (met.sort_values("id")[["id", "most", "n"]].to_numpy() == want.sort_values("id")[["id", "most", "n"]].to_numpy()).all()
    assert met[met["g"] == "large"].groupby("part").size().max() < 2_000


def test_training_rows_are_dealt_to_parts(spark, monkeypatch):
    """A table in one block of a file trains in parts of bounded size."""
    from pyspark.ml import Pipeline

    from twinsight.operators.scorers import TreeScorer

    seen = []
    fit = Pipeline.fit

    def counted(self, frame, *rest):
        seen.append([r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()])
        return fit(self, frame, *rest)

    monkeypatch.setattr(Pipeline, "fit", counted)
    monkeypatch.setattr(TreeScorer, "PART_ROWS", 100, raising=False)
    rows = spark.range(0, 1_000, 1, 1).select((F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"), F.when(F.col("id") % 7 > 3, "Yes").otherwise("No").alias("y"))
    scored = TreeScorer("y", "Yes", trees=2, depth=2).fit(rows)(rows)
    assert sum(seen[0]) == 1_000 and max(seen[0]) <= 110
    assert scored.filter("(prob >= 0.5) <> (y = 'Yes')").count() == 0
