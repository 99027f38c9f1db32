"""Populations derived from the test tables.

The tables hold no synthetic twin, so one is derived from every row by an expression: a
biased or partly copied version of the real table. All of them cover the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsight.operators.scorers import logistic_scorer
from twinsight.operators.split import stratified_split
from twinsight.operators.ssf import CampaignEconomics
from twinsight.sources import read_table

BIAS = 0.8
ECONOMICS = CampaignEconomics(retention_offer_cost=2400.0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def line_values(spark: SparkSession, folder: str, factor: float = 1.0) -> DataFrame:
    """Order lines as customers: value is the line price, scaled by ``factor`` for a biased twin."""
    lines = table(spark, folder, "lineitem")
    return lines.select("l_quantity", (F.col("l_extendedprice") * F.lit(factor)).alias("value"))


def line_scorer() -> Column:
    return logistic_scorer("l_quantity", 25.0, 10.0)


def customer_triple(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, synthetic, holdout: a stratified 70/30 split; the twin leaks rows with a debt verbatim."""
    features = ["c_nationkey", "c_acctbal", "c_mktsegment"]
    customers = table(spark, folder, "customer")
    train, holdout = stratified_split(customers, "c_mktsegment", "c_custkey", test_size=0.3)
    shifted = F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).otherwise(F.col("c_acctbal") * 0.97 + 13.5)
    synth = train.withColumn("c_acctbal", shifted)
    return train.select(*features), synth.select(*features), holdout.select(*features)


def order_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Real and synthetic orders; finished orders are copied, the others are shifted in price."""
    orders = table(spark, folder, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority")
    shifted = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(
        F.col("o_totalprice") * 1.01 + 7.0
    )
    return orders, orders.withColumn("o_totalprice", shifted)


def line_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Real and synthetic order lines; returned lines are copied, the others are shifted in price."""
    lines = table(spark, folder, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"
    )
    shifted = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(
        F.col("l_extendedprice") * 1.01 + 7.0
    )
    return lines, lines.withColumn("l_extendedprice", shifted)


def labelled_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the columns a model may see and a Yes/No target ``returned``."""
    lines = table(spark, folder, "lineitem")
    returned = F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No")
    return lines.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_linestatus", returned.alias("returned")
    )


def labelled_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a Yes/No target ``in_debt``-like label derived from their balance and segment."""
    customers = table(spark, folder, "customer")
    risky = (F.col("c_acctbal") < 2000) | (F.col("c_mktsegment") == "BUILDING")
    return customers.select(
        "c_acctbal", "c_nationkey", "c_mktsegment", F.when(risky, "Yes").otherwise("No").alias("churn")
    )
