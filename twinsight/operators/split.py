"""Exact stratified split into a training and a holdout part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinsight.functions.draws import draw_hash
from twinsight.functions.frames import materialise, quoted, rows_in_order

_BUCKET_ROWS = 1_000_000


def stratified_split(
    df: DataFrame, strata: str, key: str, test_size: float = 0.3, seed: int = 0, overall: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Split so that every stratum gives n - floor(test_size * n) of its rows to the first part.

    With ``overall`` the size is one of the whole table: the second part has ``ceil(test_size * rows)`` rows, and the first part's
    rows are apportioned to the strata by largest remainders, ties to the smaller stratum.

    Rows are ordered by a hash of their unique ``key``. Ranking a whole stratum in one window
    would put a third of the table in one task, so the hash space is cut into equal buckets:
    counts per (stratum, bucket) locate the bucket of the cut, and only that bucket is
    ranked, to find the hash value at the cut. The split itself is then a plain filter. The cuts are written
    once, one row per stratum, and joined by whatever way their size allows. A missing stratum is one of its own;
    rows with a missing key share one place in the order and so go to the same part.
    """
    cut = materialise(split_points(df, strata, key, test_size, seed, overall))
    tagged = df.join(cut, quoted(strata).eqNullSafe(F.col("_stratum")), "left")
    in_train = F.coalesce(_order_key(quoted(key), seed) <= F.col("_cut"), F.lit(False))
    names = [quoted(c) for c in df.columns]
    return tagged.filter(in_train).select(*names), tagged.filter(~in_train).select(*names)


def _order_key(key: Column, seed: int) -> Column:
    """Hash first, key second: a total order even if two hashes collide."""
    return F.coalesce(F.concat(draw_hash(key, f"split{seed}"), F.lit("/"), key.cast("string")), F.lit("missing"))


def split_points(df: DataFrame, strata: str, key: str, test_size: float, seed: int, overall: bool = False) -> DataFrame:
    """One row per stratum that gives rows to the first part: the largest order key that still belongs to it."""
    rows = df.select(quoted(strata).alias("_stratum"), _order_key(quoted(key), seed).alias("_order"))
    n_rows = df.count()
    bucketed = rows.withColumn("_bucket", F.substring("_order", 1, _bucket_digits(n_rows)))
    counts = materialise(bucketed.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    sizes = counts.groupBy("_stratum").agg(F.sum("_n").alias("_rows"))
    taken = _apportioned(sizes, n_rows, test_size) if overall else sizes.select("_stratum", _share(test_size).alias("_take"))
    taken = taken.withColumnRenamed("_stratum", "_of")
    upto = W.partitionBy("_stratum").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).join(taken, F.col("_stratum").eqNullSafe(F.col("_of")))
    cut_bucket = ranked.filter((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take")))
    cut_bucket = cut_bucket.select(
        F.col("_stratum").alias("_s"),
        F.col("_bucket").alias("_b"),
        (F.col("_take") - (F.col("_upto") - F.col("_n"))).alias("_within"),
    )
    cut_bucket = materialise(cut_bucket)  # one row per stratum
    ranks = W.partitionBy("_stratum").orderBy("_order")
    met = bucketed.join(cut_bucket, F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    at_cut = met.withColumn("_rank", F.row_number().over(ranks)).filter(F.col("_rank") == F.col("_within"))
    return at_cut.select("_stratum", F.col("_order").alias("_cut"))


def _share(test_size: float) -> Column:
    # 0.7 * 10 is a little below 7 in doubles: the guard keeps whole products whole.
    return F.col("_rows") - F.floor(F.lit(float(test_size)) * F.col("_rows") + F.lit(1e-9))


def _apportioned(sizes: DataFrame, n_rows: int, test_size: float) -> DataFrame:
    """``_stratum, _take``: rows of the first part by stratum, whole shares first and the rest to the largest remainders."""
    total = n_rows - min(math.ceil(test_size * n_rows - 1e-9), n_rows)
    wide = F.col("_rows").cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    whole = F.call_function("div", wide, F.lit(max(n_rows, 1)).cast("decimal(19,0)"))
    shares = sizes.withColumn("_whole", whole).withColumn("_rest", wide - F.col("_whole") * F.lit(n_rows).cast("decimal(19,0)"))
    left = total - (shares.agg(F.sum("_whole")).first()[0] or 0)
    ranked = rows_in_order(shares, [F.col("_rest").desc(), F.col("_stratum").asc_nulls_last()])
    return ranked.select("_stratum", (F.col("_whole") + (F.col("rank") < left).cast("long")).alias("_take"))


def _bucket_digits(rows: int) -> int:
    """Hex digits so that one bucket holds at most about a million rows."""
    digits = 1
    while rows > _BUCKET_ROWS * 16**digits and digits < 8:
        digits += 1
    return digits
