"""The registered queries, one per operator, each over whole tables.

Doubles are rounded so that the order of a floating-point sum does not show.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsight.functions.draws import keyed_normal, keyed_uniform
from twinsight.functions.frames import merge_one_row_frames
from twinsight.functions.numbers import coerce_numeric
from twinsight.operators import encoder as enc
from twinsight.operators import privacy, ssf, value
from twinsight.operators.features import distinct_rows, joint_encode, joint_levels, joint_space
from twinsight.operators.neighbours import nearest_distance
from twinsight.operators.profile import binarise, detect_labels, infer_column_kinds, label_text
from twinsight.operators.quantiles import exact_quantiles, group_quantiles
from twinsight.operators.scorers import PythonScorer, TreeScorer, apply_scorer, logistic_scorer
from twinsight.operators.sparse import SparseEncoder
from twinsight.operators.split import stratified_split
from twinsight.plans import stand_ins as st
from twinsight.sources import load_clean
from twinsight.synth.generator import draw_conditions
from twinsight.synth.schedule import noised_array, reverse_step_array, schedule_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Sources and splits


@query("load_clean")
def load_clean_customers(spark: SparkSession, sf: str) -> DataFrame:
    raw = st.table(spark, sf, "customer").withColumn(
        "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_acctbal").cast("string"))
    )
    return load_clean(raw, ["c_custkey", "not_there"], ["c_acctbal"]).select(
        "c_name", "c_nationkey", r6("c_acctbal").alias("c_acctbal"), "c_mktsegment"
    )


@query("split_stratified")
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    orders = st.table(spark, sf, "orders")
    train, holdout = stratified_split(orders, "o_orderstatus", "o_orderkey", test_size=0.3)
    return train.select("o_orderkey", "o_orderstatus", F.lit("train").alias("part")).unionByName(
        holdout.select("o_orderkey", "o_orderstatus", F.lit("holdout").alias("part"))
    )


@query("split_stratified_70")
def split_stratified_70(spark: SparkSession, sf: str) -> DataFrame:
    """A test size whose products with whole numbers are not exact in doubles; odd column names."""
    orders = st.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("_order"), F.col("o_orderstatus").alias("order.status")
    )
    train, holdout = stratified_split(orders, "order.status", "_order", test_size=0.7)
    both = train.withColumn("part", F.lit("train")).unionByName(holdout.withColumn("part", F.lit("holdout")))
    return both.toDF("o_orderkey", "o_orderstatus", "part")


@query("split_apportioned")
def split_apportioned(spark: SparkSession, sf: str) -> DataFrame:
    """One total over a stratum per supplier: its largest remainders settle who gives the odd rows."""
    lines = st.table(spark, sf, "lineitem").withColumn("line", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    train, holdout = stratified_split(lines.select("line", "l_suppkey").distinct(), "l_suppkey", "line", test_size=0.3, overall=True)
    both = train.withColumn("part", F.lit("train")).unionByName(holdout.withColumn("part", F.lit("holdout")))
    return both.groupBy("l_suppkey", "part").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last_line"))


# Cleaning and profiling


@query("coerce_numeric")
def coerce_number(spark: SparkSession, sf: str) -> DataFrame:
    orders = st.table(spark, sf, "orders").withColumn(
        "text",
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.substring("o_orderpriority", 1, 1)),
    )
    dtype = orders.schema["text"].dataType
    return orders.select(
        "o_orderkey",
        coerce_numeric(F.col("text"), dtype).alias("or_zero"),
        coerce_numeric(F.col("text"), dtype, 2.5).alias("or_midpoint"),
    )


@query("infer_column_kinds")
def infer_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kinds = infer_column_kinds(st.labelled_lines(spark, sf), "returned")
    return spark.createDataFrame(list(kinds.items()), "name string, kind string")


@query("infer_column_kinds_text")
def infer_kinds_text(spark: SparkSession, sf: str) -> DataFrame:
    kinds = infer_column_kinds(st.table(spark, sf, "part"))
    return spark.createDataFrame(list(kinds.items()), "name string, kind string")


@query("detect_labels")
def detect_label_pair(spark: SparkSession, sf: str) -> DataFrame:
    lines = st.labelled_lines(spark, sf)
    rated = st.table(spark, sf, "labels")
    rows = []
    for name, df in (("returned", lines), ("l_linestatus", lines), ("toxic", rated)):
        pair = detect_labels(df, name)
        rows.append((name, pair.negative, pair.positive))
    return spark.createDataFrame(rows, "target string, negative string, positive string")


@query("binarise_target")
def binarise_target(spark: SparkSession, sf: str) -> DataFrame:
    rated = st.table(spark, sf, "labels")
    return rated.select("doc_id", binarise(rated, "toxic", detect_labels(rated, "toxic")).alias("y"))


# Encoder and decoder


@query("encoder_fit_numeric")
def encoder_fit_numeric(spark: SparkSession, sf: str) -> DataFrame:
    lines = st.table(spark, sf, "lineitem")
    fitted = enc.TableEncoder(numeric=["l_quantity", "l_extendedprice", "l_linenumber"]).fit(lines)
    return fitted.state_table(spark).select("name", "lo", "hi", "is_int")


@query("encoder_fit_levels")
def encoder_fit_levels(spark: SparkSession, sf: str) -> DataFrame:
    lines = st.table(spark, sf, "lineitem")
    return enc.indexed_levels(lines, ["l_linenumber", "l_linestatus", "l_returnflag"])


@query("encoder_float_levels")
def encoder_float_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level text of doubles of every magnitude."""
    sizes = F.element_at(F.array(*[F.lit(x) for x in (1e-300, 1e-9, 1e-5, 1e-4, 0.5, 1.0, 1e7, 1e15, 1e16, 1e22, 1e300)]), (F.col("l_linenumber") + F.col("l_orderkey") % 5).cast("int"))
    lines = st.table(spark, sf, "lineitem").select((sizes * F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)).alias("x"))
    return enc.indexed_levels(lines, ["x"])


@query("encode_minmax")
def encode_minmax(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on the orders, applied to prices out of range and missing ones."""
    orders = st.table(spark, sf, "orders")
    fitted = enc.TableEncoder(numeric=["o_totalprice"]).fit(orders)
    moved = orders.withColumn(
        "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * 1.1 - 100.0)
    )
    return moved.select("o_orderkey", r6(fitted.scaled(moved, fitted.numeric_state[0])).alias("scaled"))


@query("encode_onehot")
def encode_onehot(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on the orders, applied with one unseen and one missing level."""
    orders = st.table(spark, sf, "orders")
    fitted = enc.TableEncoder(categorical=["o_orderpriority"]).fit(orders)
    moved = orders.withColumn(
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", "unseen").when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")),
    )
    block = fitted.one_hot(moved, fitted.category_state[0])
    return moved.select("o_orderkey", F.posexplode(block).alias("pos", "val")).withColumn("val", F.col("val").cast("double"))


@query("encode_vector")
def encode_vector(spark: SparkSession, sf: str) -> DataFrame:
    orders = st.table(spark, sf, "orders")
    fitted = enc.TableEncoder(["o_orderstatus", "o_orderpriority"], ["o_totalprice"]).fit(orders)
    rows = orders.select("o_orderkey", F.posexplode(fitted.vector(orders)).alias("pos", "val"))
    return rows.select("o_orderkey", "pos", r6(F.col("val").cast("double")).alias("val"))


@query("encoder_profile")
def encoder_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and maximum of every position of the encoded order lines."""
    lines = st.labelled_lines(spark, sf)
    fitted = enc.TableEncoder(["l_linenumber", "l_linestatus"], ["l_quantity", "l_extendedprice"]).fit(lines)
    cells = lines.select(F.posexplode(fitted.vector(lines)).alias("pos", "val"))
    x = F.col("val").cast("double")
    return cells.groupBy("pos").agg(F.count("val").alias("n"), r6(F.avg(x)).alias("mean"), r6(F.max(x)).alias("top"))


@query("encoder_dim")
def encoder_dim(spark: SparkSession, sf: str) -> DataFrame:
    fitted = enc.TableEncoder.infer(st.labelled_lines(spark, sf), "returned").fit(st.labelled_lines(spark, sf))
    return spark.createDataFrame([(fitted.dim,)], "dim long")


@query("decode_numeric")
def decode_numeric(spark: SparkSession, sf: str) -> DataFrame:
    customers = st.table(spark, sf, "customer")
    fitted = enc.TableEncoder(numeric=["c_acctbal", "c_nationkey"]).fit(customers)
    cells = F.array((F.col("c_acctbal") / 8000.0).cast("float"), (F.col("c_nationkey") / 25.0).cast("float"))
    rows = fitted.inverse_transform(customers.withColumn("x", cells), "x", keep=["c_custkey"])
    return rows.select("c_custkey", r6("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))


@query("decode_category")
def decode_category(spark: SparkSession, sf: str) -> DataFrame:
    """Arg-max over small integer scores, so that ties are common."""
    customers = st.table(spark, sf, "customer")
    fitted = enc.TableEncoder(categorical=["c_mktsegment"]).fit(customers)
    width = len(fitted.category_state[0].levels)
    scores = F.array(*[F.pmod(F.col("c_custkey") * (i + 3), F.lit(7)).cast("float") for i in range(width)])
    return fitted.inverse_transform(customers.withColumn("x", scores), "x", keep=["c_custkey"]).withColumnRenamed(
        "c_mktsegment", "decoded"
    )


@query("encode_roundtrip")
def encode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    orders = st.table(spark, sf, "orders")
    fitted = enc.TableEncoder(["o_orderstatus", "o_orderpriority"], ["o_totalprice"]).fit(orders)
    coded = fitted.transform(orders).withColumn("price", F.col("o_totalprice"))
    back = fitted.inverse_transform(coded, keep=["o_orderkey", "price"])
    close = F.abs(F.col("o_totalprice") - F.col("price")) < 0.25
    return back.select("o_orderkey", "o_orderstatus", "o_orderpriority", close.alias("price_is_close"))


def _many_levels(spark: SparkSession, sf: str) -> tuple[DataFrame, SparseEncoder]:
    lines = st.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "l.part key")
    return lines, SparseEncoder(["l.part key", "l_suppkey"], ["l_quantity"]).fit(lines)


@query("encode_many_levels")
def encode_many_levels(spark: SparkSession, sf: str) -> DataFrame:
    """A level per part and per supplier: slots of every line, summed by line so that repeated lines show."""
    lines, fitted = _many_levels(spark, sf)
    rows = fitted.transform(lines).select("l_orderkey", "l_linenumber", F.explode(F.arrays_zip("slots", "values")).alias("cell"))
    rows = rows.groupBy("l_orderkey", "l_linenumber", F.col("cell.slots").alias("slot"))
    return rows.agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("cell.values").cast("double"))).alias("total"))


@query("decode_many_levels")
def decode_many_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Back from sparse rows: the line's own part against another one, above and below the slots that are not listed."""
    lines, fitted = _many_levels(spark, sf)
    first, n = fitted.blocks[0]
    rows = fitted.transform(lines)
    other = (F.lit(first) + F.pmod(F.col("l_orderkey") * 7, F.lit(n))).cast("long")
    sign = F.when(F.col("l_quantity") > 25, 1.0).otherwise(-1.0)
    own = F.element_at("slots", -2)  # before the supplier's
    mine, theirs = F.struct(own.alias("s"), sign.alias("v")), F.struct(other.alias("s"), (sign * 0.5).alias("v"))
    cells = F.when(own == other, F.array(mine)).otherwise(F.sort_array(F.array(mine, theirs)))
    held = rows.select("l_orderkey", "l_linenumber", cells["s"].alias("slots"), cells["v"].cast("array<float>").alias("values"))
    back = fitted.inverse_transform(held, keep=["l_orderkey", "l_linenumber"])
    return back.select("l_orderkey", "l_linenumber", F.col("`l.part key`").alias("decoded"))


@query("fit_transform")
def fit_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on and applied to the same customers, one row per customer and position."""
    customers = st.table(spark, sf, "customer")
    coded = enc.TableEncoder(["c_mktsegment"], ["c_acctbal"]).fit_transform(customers, "x")
    return coded.select("c_custkey", F.posexplode("x").alias("pos", "val")).withColumn("val", r6(F.col("val").cast("double")))


@query("label_text")
def label_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Labels to 0 / 1 and back to text; every other level reads as the negative label."""
    orders = st.table(spark, sf, "orders")
    labels = detect_labels(orders, "o_orderpriority")
    y = binarise(orders, "o_orderpriority", labels)
    return orders.select("o_orderkey", y.alias("y"), label_text(y, labels).alias("label"))


@query("split_positional")
def split_positional(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows by key against the rest: the smallest 30 % of the customers' key range."""
    customers = st.table(spark, sf, "customer")
    cut = customers.agg(F.floor(F.max("c_custkey") * 0.3)).first()[0]
    return customers.select("c_custkey", F.when(F.col("c_custkey") <= F.lit(cut), "first").otherwise("rest").alias("part"))


@query("any_names")
def any_names(spark: SparkSession, sf: str) -> DataFrame:
    """Profile, encoder, tiers, weights and scorer on columns whose names hold dots, blanks and quotes."""
    named = {"c_acctbal": "Monthly.Charge", "c_mktsegment": "pl.an `x`", "c_nationkey": "na tion", "churn": "churn?.label"}
    customers = st.labelled_customers(spark, sf).withColumnsRenamed(named)
    kinds = infer_column_kinds(customers, "churn?.label")
    labels = detect_labels(customers, "churn?.label")
    fitted = enc.TableEncoder.infer(customers, "churn?.label").fit(customers)
    coded = value.value_tiers(fitted.transform(customers, "en.coded"), "Monthly.Charge")
    coded = coded.withColumn("w.t", value.weight_column(customers, "Monthly.Charge"))
    coded = value.sampling_probability(coded, "w.t", "pro.b").withColumn("y", binarise(coded, "churn?.label", labels))
    back = fitted.inverse_transform(coded, "en.coded", keep=["tier", "y", "w.t", "pro.b"])
    scored = TreeScorer("churn?.label", "Yes", trees=2).fit(customers)(customers)
    n_scored = scored.filter("prob BETWEEN 0 AND 1").count()
    return back.groupBy("tier", F.col("`pl.an ``x```").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), r6(F.sum("`pro.b`")).alias("probability"), F.sum("`w.t`").alias("weight"),
        F.lit(",".join(sorted(kinds.values()))).alias("kinds"), F.lit(n_scored).alias("n_scored"),
    )


# Value tiers, weights, resampling


@query("value_quantiles")
def value_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return _quantile_table(spark, sf)


@query("value_quantiles_by_part")
def value_quantiles_by_part(spark: SparkSession, sf: str) -> DataFrame:
    """A group per part, as a table."""
    found = group_quantiles(st.table(spark, sf, "lineitem"), "l_extendedprice", [1 / 3, 2 / 3, 0.9], "l_partkey")
    q = F.col("quantiles")
    return found.select("l_partkey", "n", r6(q[0]).alias("q33"), r6(q[1]).alias("q67"), r6(q[2]).alias("q90"))


def _quantile_table(spark: SparkSession, sf: str, **options) -> DataFrame:
    lines = st.table(spark, sf, "lineitem")
    cuts = exact_quantiles(lines, "l_extendedprice", [1 / 3, 2 / 3, 0.9], group="l_returnflag", **options)
    rows = [(g, *[round(x, 6) for x in q]) for g, q in cuts.items()]
    return spark.createDataFrame(rows, "l_returnflag string, q33 double, q67 double, q90 double")


@query("value_tiers")
def value_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return value.value_tiers(st.table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "tier")


@query("value_tier_codes")
def value_tier_codes(spark: SparkSession, sf: str) -> DataFrame:
    orders = st.table(spark, sf, "orders")
    coded = orders.withColumn("flat", F.lit(7.5))
    return coded.select(
        "o_orderkey",
        value.tier_code_column(coded, "o_totalprice").alias("tier"),
        value.tier_code_column(coded, "flat").alias("flat_tier"),
        value.tier_code_column(coded, None).alias("no_value_tier"),
    )


@query("oversample_weights")
def oversample_weights(spark: SparkSession, sf: str) -> DataFrame:
    customers = st.table(spark, sf, "customer")
    return customers.select(
        "c_custkey",
        value.weight_column(customers, "c_acctbal").alias("weight"),
        value.weight_column(customers, "c_acctbal", enabled=False).alias("flat_weight"),
    )


def _weighted_customers(spark: SparkSession, sf: str) -> DataFrame:
    customers = st.table(spark, sf, "customer")
    return customers.withColumn("weight", value.weight_column(customers, "c_acctbal"))


@query("sampling_probability")
def sampling_probability(spark: SparkSession, sf: str) -> DataFrame:
    rows = value.sampling_probability(_weighted_customers(spark, sf), "weight")
    return rows.select("c_custkey", F.round("probability", 9).alias("probability"))


@query("weighted_resample")
def weighted_resample(spark: SparkSession, sf: str) -> DataFrame:
    drawn = value.weighted_resample(_weighted_customers(spark, sf), "weight", key=F.col("c_custkey"), seed=1)
    return drawn.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("copies"))


@query("weighted_resample_exact")
def weighted_resample_exact(spark: SparkSession, sf: str) -> DataFrame:
    """As many draws as there are order lines, over the customers."""
    n = st.table(spark, sf, "lineitem").count()
    drawn = value.exact_resample(_weighted_customers(spark, sf), "weight", n, F.col("c_custkey"), seed=3)
    return drawn.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("copies"))


@query("condition_vector")
def condition_vector(spark: SparkSession, sf: str) -> DataFrame:
    orders = st.table(spark, sf, "orders")
    y = binarise(orders, "o_orderstatus", detect_labels(orders, "o_orderstatus"))
    cells = value.condition_vector(y, value.tier_code_column(orders, "o_totalprice"))
    rows = orders.select("o_orderkey", F.posexplode(cells).alias("pos", "val"))
    return rows.withColumn("val", F.col("val").cast("double"))


@query("target_prior")
def target_prior(spark: SparkSession, sf: str) -> DataFrame:
    lines = st.labelled_lines(spark, sf)
    y = binarise(lines, "returned", detect_labels(lines, "returned"))
    return lines.agg(r6(F.avg(y)).alias("prior"))


# Decision fidelity


def _line_roi(spark: SparkSession, sf: str) -> DataFrame:
    real = ssf.score_population(st.line_values(spark, sf), st.line_scorer(), "value", ssf.REAL)
    twin = ssf.score_population(st.line_values(spark, sf, st.BIAS), st.line_scorer(), "value", "synthetic")
    family = ssf.strategy_table(spark)
    return ssf.strategy_roi(real.unionByName(twin), [ssf.REAL, "synthetic"], family, st.ECONOMICS)


def _line_fidelity(spark: SparkSession, sf: str, **options) -> ssf.FidelityResult:
    options.setdefault("econ", st.ECONOMICS)
    return ssf.ssf_score(
        st.line_values(spark, sf), st.line_values(spark, sf, st.BIAS), st.line_scorer(), "value", **options
    )


def _rounded_strategies(rows: DataFrame, *first: str) -> DataFrame:
    return rows.select(
        *first,
        "segment",
        "discount",
        "threshold",
        F.round("roi_real", 2).alias("roi_real"),
        F.round("roi_syn", 2).alias("roi_syn"),
        "decision_real",
        "decision_syn",
        "agree",
    )


def _rounded_summary(rows: DataFrame, *first: str) -> DataFrame:
    return rows.select(
        *first, r6("ssf").alias("ssf"), "n_strategies", "n_agree", F.round("mean_roi_gap_pct", 5).alias("mean_roi_gap_pct")
    )


@query("score_logistic")
def score_logistic(spark: SparkSession, sf: str) -> DataFrame:
    lines = st.table(spark, sf, "lineitem")
    scored = apply_scorer(lines, st.line_scorer())
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("prob").alias("prob"))


@query("score_python_model")
def score_python_model(spark: SparkSession, sf: str) -> DataFrame:
    """A plain Python predict function over two columns."""

    def predict(rows):
        odds = (rows["l_quantity"] - 25.0) / 10.0 - rows["l_discount"]
        return 1.0 / (1.0 + (-odds).map(math.exp))

    lines = st.table(spark, sf, "lineitem")
    scored = apply_scorer(lines, PythonScorer(predict, ["l_quantity", "l_discount"]))
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("prob").alias("prob"))


@query("score_gbt")
def score_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that hold of any well-trained ensemble of the default size, over all customers."""
    customers = st.labelled_customers(spark, sf)
    scored = TreeScorer("churn", "Yes").fit(customers)(customers)
    p, yes = F.col("prob"), F.col("churn") == "Yes"
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(yes).alias("n_positive"),
        F.every((p >= 0) & (p <= 1)).alias("in_range"),
        (F.avg(F.when(yes, p)) > F.avg(F.when(~yes, p))).alias("positives_score_higher"),
        (F.avg(((p >= 0.5) == yes).cast("int")) > 0.9).alias("mostly_right"),
    )


@query("strategy_family")
def strategy_family(spark: SparkSession, sf: str) -> DataFrame:
    """The default grid with the number of order lines each strategy would contact."""
    real = _line_roi(spark, sf).filter(F.col("population") == ssf.REAL)
    return real.select("segment", "discount", "threshold", "n_flagged")


@query("strategy_roi")
def strategy_roi(spark: SparkSession, sf: str) -> DataFrame:
    return _line_roi(spark, sf).select(
        "population", "segment", "discount", "threshold", F.round("roi", 2).alias("roi")
    )


@query("strategy_decisions")
def strategy_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _line_roi(spark, sf)
    return rows.select("population", "segment", "discount", "threshold", ssf.decision(F.col("roi")).alias("go"))


@query("ssf_per_strategy")
def ssf_per_strategy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_strategies(_line_fidelity(spark, sf).per_strategy)


@query("ssf_score")
def ssf_score(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_summary(_line_fidelity(spark, sf).summary)


@query("ssf_custom_family")
def ssf_custom_family(spark: SparkSession, sf: str) -> DataFrame:
    """A family given as a table, with one strategy listed twice and one unknown segment."""
    family = spark.createDataFrame(
        [("high", 0.1, 0.5), ("all", 0.2, 0.7), ("all", 0.2, 0.7), ("mid", 0.0, 0.42), ("none", 0.1, 0.3)],
        "segment string, discount double, threshold double",
    )
    return _rounded_strategies(_line_fidelity(spark, sf, strategy_family=family).per_strategy)


@query("ssf_custom_econ")
def ssf_custom_econ(spark: SparkSession, sf: str) -> DataFrame:
    econ = ssf.CampaignEconomics(800.0, 0.35, 0.25, 0.4)
    return _rounded_summary(_line_fidelity(spark, sf, econ=econ).summary)


@query("ssf_decision_spread")
def ssf_decision_spread(spark: SparkSession, sf: str) -> DataFrame:
    return _line_fidelity(spark, sf).summary.select("n_strategies", "n_go_real", "n_go_syn", "is_discriminating")


@query("ssf_compare_candidates")
def ssf_compare_candidates(spark: SparkSession, sf: str) -> DataFrame:
    candidates = {f"x{f}": st.line_values(spark, sf, f) for f in (1.0, 0.9, 0.8, 0.6)}
    compared = ssf.compare_candidates(
        st.line_values(spark, sf), candidates, st.line_scorer(), "value", econ=st.ECONOMICS
    )
    return _rounded_summary(ssf.summarise(compared, ["candidate"]), "candidate")


@query("ssf_many_candidates")
def ssf_many_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate per supplier: its own lines against all lines."""
    lines = st.table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("value"), "l_suppkey")
    compared = ssf.compare_by_key(lines.drop("l_suppkey"), lines, "l_suppkey", st.line_scorer(), "value", econ=st.ECONOMICS)
    return _rounded_summary(ssf.summarise(compared, ["candidate"]), "candidate")


@query("ssf_threshold_per_order")
def ssf_threshold_per_order(spark: SparkSession, sf: str) -> DataFrame:
    """A strategy per order, each with a threshold of its own, summed up by segment."""
    orders = st.table(spark, sf, "orders")
    segment = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "all").otherwise("low")
    family = orders.select(
        segment.alias("segment"), ((F.col("o_orderkey") % 4 + 1) / 20).alias("discount"), (F.col("o_totalprice") / 600_000).alias("threshold")
    )
    real, synthetic = st.line_values(spark, sf), st.line_values(spark, sf, st.BIAS)
    result = ssf.ssf_score(real, synthetic, F.col("value") / 120_000, "value", strategy_family=family, econ=st.ECONOMICS)
    return _rounded_summary(ssf.summarise(result.compared, ["segment"]), "segment")


# Privacy and novelty


@query("joint_encode")
def joint_encode_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers share balance and nation; missing balances become 0."""
    customers = st.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("acctbal"),
        F.col("c_nationkey").alias("nationkey"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("only_here"),
    )
    suppliers = st.table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("string").alias("nationkey"), F.col("s_name").alias("name")
    )
    space = joint_space(customers.drop("c_custkey"), suppliers)
    return joint_encode(customers, space, keep=["c_custkey"])


@query("joint_levels")
def joint_level_union(spark: SparkSession, sf: str) -> DataFrame:
    train, synth, holdout = st.customer_triple(spark, sf)
    return joint_levels(joint_space(synth, train, holdout), synth, train, holdout)


@query("nn_distance")
def nn_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = privacy.member_distances(*st.customer_triple(spark, sf))
    return rows.select(
        "c_nationkey", r6("c_acctbal").alias("c_acctbal"), "c_mktsegment", "n_member", "n_other", r6("distance").alias("distance")
    )


@query("nn_distance_orders")
def nn_distance_orders(spark: SparkSession, sf: str) -> DataFrame:
    real, synth = st.order_pair(spark, sf)
    rows = _pair_distances(real, synth)
    return rows.select("o_totalprice", "o_orderstatus", "o_orderpriority", "n", r6("distance").alias("distance"))


@query("nn_distance_lines")
def nn_distance_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Distance profile of all order lines against their twin, by returned flag."""
    rows = _pair_distances(*st.line_pair(spark, sf))
    return rows.groupBy("l_returnflag").agg(
        F.sum("n").alias("n_rows"),
        r6(F.avg("distance")).alias("mean_distance"),
        r6(F.max("distance")).alias("max_distance"),
        F.sum(F.when(F.col("distance") == 0, F.col("n")).otherwise(0)).alias("n_copied"),
    )


@query("nn_distance_wide")
def nn_distance_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Ten columns of one range, where no box is far from any query: orders against a partly copied twin."""
    orders = st.table(spark, sf, "orders")
    drawn = {f"x{i}": keyed_uniform(F.col("o_orderkey"), f"wide{i}") for i in range(10)}
    real = orders.select("o_orderstatus", *[x.alias(c) for c, x in drawn.items()])
    moved = {c: F.when(F.col("o_orderstatus") == "F", F.col(c)).otherwise(1 - F.col(c) * F.col(c)) for c in drawn}
    rows = _pair_distances(real, real.withColumns(moved))
    return rows.groupBy("o_orderstatus").agg(
        F.sum("n").alias("n_rows"), r6(F.avg("distance")).alias("mean_distance"), r6(F.max("distance")).alias("max_distance")
    )


def _pair_distances(real: DataFrame, synth: DataFrame) -> DataFrame:
    space = joint_space(synth, real)
    queries = distinct_rows(joint_encode(real, space), space, n=F.lit(1))
    return nearest_distance(queries, distinct_rows(joint_encode(synth, space), space), space, payload=("n",))


@query("membership_scores")
def membership_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = privacy.membership_scores(*st.customer_triple(spark, sf))
    return rows.groupBy(r6("score").alias("score")).agg(
        F.sum("n_member").alias("n_member"), F.sum("n_other").alias("n_other")
    )


@query("membership_inference_auc")
def membership_inference_auc(spark: SparkSession, sf: str) -> DataFrame:
    auc = privacy.membership_inference_auc(*st.customer_triple(spark, sf))
    return auc.select(r6("membership_inference_auc").alias("membership_inference_auc"))


@query("novelty_rate")
def novelty_rate(spark: SparkSession, sf: str) -> DataFrame:
    train, synth, _ = st.customer_triple(spark, sf)
    return privacy.novelty_rate(train, synth).select(r6("novelty_rate").alias("novelty_rate"))


@query("novelty_rate_lines")
def novelty_rate_lines(spark: SparkSession, sf: str) -> DataFrame:
    real, synth = st.line_pair(spark, sf)
    return privacy.novelty_rate(real, synth).select(r6("novelty_rate").alias("novelty_rate"))


@query("membership_small_units")
def membership_small_units(spark: SparkSession, sf: str) -> DataFrame:
    """Order prices in a tiny unit: the attack must not lose its ties and orders to rounding."""
    real, synth = st.order_pair(spark, sf)
    tiny = F.col("o_totalprice") / 1e12
    real, synth = (df.select("o_orderstatus", tiny.alias("price")) for df in (real, synth))
    train, holdout = real.filter("o_orderstatus <> 'O'"), real.filter("o_orderstatus = 'O'")
    auc = privacy.membership_inference_auc(train.select("price"), synth.filter("o_orderstatus <> 'O'").select("price"), holdout.select("price"))
    return auc.select(r6("membership_inference_auc").alias("membership_inference_auc"))


@query("novelty_outlier")
def novelty_outlier(spark: SparkSession, sf: str) -> DataFrame:
    """One price is huge, and the columns carry names that helper columns could have."""
    real, synth = st.order_pair(spark, sf)
    names = {"o_totalprice": "n", "o_orderstatus": "a.b", "o_orderpriority": "distance"}
    huge = F.when(F.col("o_totalprice") == F.lit(real.agg(F.max("o_totalprice")).first()[0]), 1e12).otherwise(F.col("o_totalprice"))
    odd = real.withColumn("o_totalprice", huge).withColumnsRenamed(names), synth.withColumnsRenamed(names)
    return privacy.novelty_rate(*odd).select(r6("novelty_rate").alias("novelty_rate"))


@query("novelty_rate_wide")
def novelty_rate_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A tolerance beyond sqrt(2), where a category may differ."""
    train, synth, _ = st.customer_triple(spark, sf)
    return privacy.novelty_rate(train, synth, tol=3.0).select(r6("novelty_rate").alias("novelty_rate"))


@query("three_axis_report")
def three_axis_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_report(privacy.three_axis_report(*st.customer_triple(spark, sf)))


def _rounded_report(report: DataFrame) -> DataFrame:
    return report.select(
        r6("membership_inference_auc").alias("membership_inference_auc"),
        "membership_inference_risk",
        r6("novelty_rate").alias("novelty_rate"),
        "passes_privacy",
    )


@query("deployment_gate")
def deployment_gate(spark: SparkSession, sf: str) -> DataFrame:
    """All three axes in one row, with customers scored by their balance."""
    train, synth, holdout = st.customer_triple(spark, sf)
    fidelity = ssf.ssf_score(
        train,
        synth,
        logistic_scorer("c_nationkey", 12.0, 6.0),
        "c_acctbal",
        econ=ssf.CampaignEconomics(retention_offer_cost=200.0),
    )
    report = _rounded_report(privacy.three_axis_report(train, synth, holdout))
    return privacy.deployment_gate(report, _rounded_summary(fidelity.summary))


# Synthesizer


def _noised(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled order prices, a keyed step and keyed noise."""
    key = F.col("o_orderkey")
    rows = st.table(spark, sf, "orders").select(
        key,
        F.array(F.col("o_totalprice") / 500000.0, F.col("o_custkey") / 10000.0).alias("x"),
        F.floor(keyed_uniform(key, "t") * 100).cast("long").alias("t"),
        F.array(keyed_normal(key, "e0"), keyed_normal(key, "e1")).alias("eps"),
    )
    return rows.join(F.broadcast(schedule_table(spark, 100)), "t")  # 100 rows


@query("forward_noising")
def forward_noising(spark: SparkSession, sf: str) -> DataFrame:
    noised = noised_array(F.col("x"), F.col("eps"), F.col("alpha_bar"))
    rows = _noised(spark, sf).select("o_orderkey", "t", F.posexplode(noised).alias("pos", "val"))
    return rows.withColumn("val", r6("val"))


@query("reverse_step")
def reverse_step(spark: SparkSession, sf: str) -> DataFrame:
    before = schedule_table(spark, 100).select((F.col("t") + 1).alias("t"), F.col("alpha_bar").alias("before"))
    rows = _noised(spark, sf).join(F.broadcast(before), "t", "left")  # 100 rows
    scaled = F.transform("x", lambda v: v * 6.0 - 2.0)
    stepped = reverse_step_array(scaled, F.col("eps"), F.col("alpha_bar"), F.coalesce("before", F.lit(1.0)))
    return rows.select("o_orderkey", "t", F.posexplode(stepped).alias("pos", "val")).withColumn("val", r6("val"))


@query("sample_conditions")
def sample_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """One drawn condition per order, at the positive rate of the orders."""
    orders = st.table(spark, sf, "orders")
    y = binarise(orders, "o_orderstatus", detect_labels(orders, "o_orderstatus"))
    drawn = draw_conditions(orders, "o_orderkey", value.target_prior(orders, y))
    return drawn.select(F.col("id").alias("o_orderkey"), "y", "tier")


