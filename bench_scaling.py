"""Measure how the main operators scale: one line of JSON per measurement.

Compares each operator with its plain form on the same tables. Settings as in bench.py.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from twinsight import Strategy, SynthConfig, TableSynthesizer, novelty_rate, ssf_score  # noqa: E402
from twinsight.operators.features import distinct_rows, joint_encode, joint_space, squared_distance  # noqa: E402
from twinsight.operators.neighbours import nearest_distance  # noqa: E402
from twinsight.operators.ssf import add_tiers, default_strategy_family, score_population  # noqa: E402
from twinsight.plans import stand_ins as st  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SMALL = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(name: str, fn, **facts) -> None:
    started = time.perf_counter()
    extra = fn() or {}
    print(json.dumps({"name": name, "seconds": round(time.perf_counter() - started, 2), **facts, **extra}), flush=True)


def fidelity(spark: SparkSession, family: list[Strategy]) -> None:
    run(
        ssf_score(
            st.line_values(spark, FOLDER), st.line_values(spark, FOLDER, 0.8), st.line_scorer(), "value", family, st.ECONOMICS
        ).per_strategy
    )


def fidelity_by_loop(spark: SparkSession, family: list[Strategy]) -> None:
    """One job per strategy and population, as the definition reads."""
    for factor in (1.0, 0.8):
        scored = score_population(st.line_values(spark, FOLDER, factor), st.line_scorer(), "value", "p")
        tiered = add_tiers(scored)
        for s in family:
            hit = F.col("prob") >= s.threshold
            hit = hit if s.segment == "all" else hit & (F.col("tier") == s.segment)
            p, v = F.col("prob"), F.col("value")
            tiered.filter(hit).agg(F.sum(p * v), F.sum((1 - p) * v), F.count("*")).collect()


def neighbours(real: DataFrame, synth: DataFrame, pruned: bool) -> None:
    space = joint_space(synth, real)
    queries = distinct_rows(joint_encode(real, space), space, n=F.lit(1))
    index = distinct_rows(joint_encode(synth, space), space)
    if pruned:
        run(nearest_distance(queries, index, space, payload=("n",)))
        return
    other = index.select(*[F.col(c).alias(f"ix_{c}") for c in space.columns])
    pairs = queries.crossJoin(other)  # the quadratic form, here for comparison only
    run(pairs.groupBy(*space.columns).agg(F.sqrt(F.min(squared_distance(space, "", "ix_")))))


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    grid = default_strategy_family()
    rng = np.random.default_rng(0)
    thousand = [Strategy(grid[i % 48].segment, float(rng.random()), float(rng.random())) for i in range(1000)]
    fidelity(spark, grid)
    timed("ssf one pass", lambda: fidelity(spark, grid), strategies=48)
    timed("ssf one pass", lambda: fidelity(spark, thousand), strategies=1000)
    timed("ssf loop", lambda: fidelity_by_loop(spark, grid), strategies=48)

    timed("neighbours pruned", lambda: neighbours(*st.order_pair(spark, SMALL), True), rows="15k x 15k")
    timed("neighbours cross join", lambda: neighbours(*st.order_pair(spark, SMALL), False), rows="15k x 15k")
    timed("neighbours pruned", lambda: neighbours(*st.order_pair(spark, FOLDER), True), rows="150k x 150k")
    timed("neighbours pruned", lambda: neighbours(*st.line_pair(spark, FOLDER), True), rows="600k x 600k")
    timed("novelty", lambda: run(novelty_rate(*st.line_pair(spark, FOLDER))), rows="600k x 600k")

    for workers in (1, 4, 8):
        config = SynthConfig(epochs=1, surrogate_epochs=0, use_decision_conditioning=False, workers=workers)
        model = TableSynthesizer(config)
        model.fit(st.labelled_lines(spark, SMALL), "returned", "l_extendedprice")
        timed("epoch, width 384", lambda: model._train(model.training_rows(st.labelled_lines(spark, SMALL))), rows=60_000, workers=workers)
    timed("sample, width 384, 100 steps", lambda: run(model.sample(20_000)), rows=20_000)
    demo = SynthConfig(epochs=60)
    customers = st.labelled_customers(spark, SMALL)
    five = customers.unionByName(customers).unionByName(customers)
    timed("fit 60 epochs, width 384", lambda: TableSynthesizer(demo).fit(five, "churn", "c_acctbal") and None, rows=4_500)
    spark.stop()


if __name__ == "__main__":
    main()
