"""Customer-value tiers, oversampling weights and weighted resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsight.functions.draws import draw_hash, keyed_uniform, poisson_chunks, poisson_from_uniform
from twinsight.functions.frames import materialise, quoted, rows_in_order
from twinsight.functions.numbers import coerce_numeric
from twinsight.operators.quantiles import exact_quantiles

# Tercile cuts, oversampling defaults, and the closeness rule for a constant column.
TERCILES = [1 / 3, 2 / 3]
TOP_QUANTILE = 0.90
OVERSAMPLE_FACTOR = 2.0
CLOSE_ATOL = 1e-8
CLOSE_RTOL = 1e-5


def value_vector(df: DataFrame, value: str | None) -> Column:
    """Coerced customer value, missing to 0; constant 1 when there is no value column."""
    if value is None:
        return F.lit(1.0)
    return coerce_numeric(quoted(value), df.schema[value].dataType, 0.0)


def greater(x: Column, cut: float) -> Column:
    """``x > cut`` with NaN on either side giving False (Spark orders NaN above all numbers)."""
    return (x > F.lit(float(cut))) & ~F.isnan(x) & ~F.isnan(F.lit(float(cut)))


def tier_name(v: Column, t1: Column, t2: Column) -> Column:
    return F.when(v > t2, "high").when(v > t1, "mid").otherwise("low")


def value_tiers(df: DataFrame, value: str, out: str = "tier") -> DataFrame:
    """Add high / mid / low by tercile of ``value``."""
    v = value_vector(df, value)
    cuts = exact_quantiles(df.select(v.alias("v")), "v", TERCILES).get("", [0.0, 0.0])
    return df.withColumn(out, tier_name(v, F.lit(cuts[0]), F.lit(cuts[1])))


def is_constant(df: DataFrame, value: str) -> bool:
    """Every value lies within the closeness tolerance of the smallest one."""
    v = value_vector(df, value)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    return lo is None or hi - lo <= CLOSE_ATOL + CLOSE_RTOL * abs(lo)


def tier_code_column(df: DataFrame, value: str | None) -> Column:
    """0 / 1 / 2 by tercile; 0 throughout without a value column or with a constant one."""
    if value is None or is_constant(df, value):
        return F.lit(0)
    v = value_vector(df, value)
    t1, t2 = exact_quantiles(df.select(v.alias("v")), "v", TERCILES)[""]
    return F.when(greater(v, t2), 2).when(greater(v, t1), 1).otherwise(0)


def weight_column(
    df: DataFrame,
    value: str | None,
    factor: float = OVERSAMPLE_FACTOR,
    top_quantile: float = TOP_QUANTILE,
    enabled: bool = True,
) -> Column:
    """``factor`` for rows at or above the top quantile of value, else 1."""
    if value is None or not enabled:
        return F.lit(1.0)
    v = value_vector(df, value)
    cuts = exact_quantiles(df.select(v.alias("v")), "v", [top_quantile])
    if not cuts:
        return F.lit(1.0)
    return F.when(v >= F.lit(cuts[""][0]), F.lit(float(factor))).otherwise(F.lit(1.0))


def sampling_probability(df: DataFrame, weight: str, out: str = "probability") -> DataFrame:
    """Add weight over total weight; the total is one aggregate, read once."""
    total = df.agg(F.sum(quoted(weight))).first()[0] or 1.0
    return df.withColumn(out, quoted(weight) / F.lit(float(total)))


def weighted_resample(
    df: DataFrame, weight: str, n: int | None = None, key: Column | None = None, seed: int = 42
) -> DataFrame:
    """Draw about ``n`` rows with replacement, with expectation n * w / sum(w) per row.

    Each row decides on its own copies (Poisson bootstrap), so there is no shuffle and no
    global draw list. A large mean is cut into parts of at most 1 that draw separately, so a
    row with a third of all weight is exploded in the stream and never held as one count.
    With ``key`` the draw is a pure function of (key, seed); without, it is seeded per partition.
    """
    total, rows = df.agg(F.sum(quoted(weight)), F.count(F.lit(1))).first()
    if not rows:
        return df
    scale = float(rows if n is None else n) / float(total)
    mean = quoted(weight) * F.lit(scale)
    chunks = poisson_chunks(mean)
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(1).cast("long"), chunks)))
    if key is None:
        u = F.rand(seed)
    else:
        u = keyed_uniform(F.concat_ws("/", key.cast("string"), F.col("_part").cast("string")), f"resample{seed}")
    drawn = parts.withColumns({"_u": u, "_mean": mean / chunks})
    copies = F.array_repeat(F.lit(0), poisson_from_uniform("_u", "_mean"))
    return drawn.withColumn("_copy", F.explode(copies)).drop("_part", "_u", "_mean", "_copy")


#: Draws of a cell of the exact resample, and rows of a bucket, about.
_CELL_DRAWS, _BUCKET_ROWS = 50_000, 200_000


def exact_resample(df: DataFrame, weight: str, n: int, key: Column, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows of ``df`` drawn with replacement, each draw in proportion to ``weight`` (a multinomial sample).

    Rows lie side by side on a line, as long as their weight, in the order of a hash of their unique ``key``; a draw is a
    uniform point on it. Weights are summed by hash bucket, so running sums stay inside a bucket. The line is cut into
    equal cells, which the points fill evenly whatever the weights: a row with a third of all weight is a third of
    the cells, not one group. In a cell, points and rows are put in order and each point takes the row it
    lies on, so no point meets other rows. The draw depends on keys, weights and seed, not on partitions.

    Rows whose weight is null, NaN, zero or negative are never drawn. Without any weight the result is empty.
    """
    w = quoted(weight).cast("double")
    order = F.concat(draw_hash(key, f"line{seed}"), F.lit("/"), key.cast("string"))
    weighed = df.select(F.struct("*").alias("row"), w.alias("w"), order.alias("at")).filter((F.col("w") > 0) & ~F.isnan("w"))
    rows = df.count()
    digits = next(d for d in range(1, 9) if rows <= _BUCKET_ROWS * 16**d or d == 8)
    weighed = weighed.withColumn("bucket", F.substring("at", 1, digits))
    placed = materialise(rows_in_order(weighed.groupBy("bucket").agg(F.sum("w").alias("in_bucket")), [F.col("bucket")]))
    total = placed.agg(F.sum("in_bucket")).first()[0]
    if not total or n <= 0:
        return df.limit(0)
    earlier = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = placed.select("bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0.0)).alias("start"))
    inside = Window.partitionBy("bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    line = weighed.withColumn("before", F.coalesce(F.sum("w").over(inside), F.lit(0.0))).join(starts, "bucket")
    line = line.select("row", (F.col("start") + F.col("before")).alias("low"), "w")
    cells = max(-(-n // _CELL_DRAWS), 1)
    cell_of = lambda x: F.least(F.greatest(F.floor(x / F.lit(total) * cells), F.lit(0)), F.lit(cells - 1)).cast("long")
    slack = F.lit(total * 1e-9)  # a row in a neighbouring cell too many does no harm
    covered = F.explode(F.sequence(cell_of(F.col("low") - slack), cell_of(F.col("low") + F.col("w") + slack)))
    pieces = line.select("row", covered.alias("cell"), F.col("low").alias("pos"), F.lit(0).alias("point"))
    u = keyed_uniform(F.col("id"), f"draw{seed}")
    points = df.sparkSession.range(n).select(F.lit(None).alias("row"), (u * total).alias("pos")).select("row", cell_of(F.col("pos")).alias("cell"), "pos", F.lit(1).alias("point"))
    along = Window.partitionBy("cell").orderBy("pos", "point").rowsBetween(Window.unboundedPreceding, 0)
    met = pieces.unionByName(points).withColumn("row", F.last("row", ignorenulls=True).over(along))
    return met.filter("point = 1").select("row.*")


def condition_vector(target: Column, tier: Column) -> Column:
    """Target one-hot (2) followed by tier one-hot (3), as ``array<float>``."""

    def flag(hit: Column) -> Column:
        return hit.cast("float")

    return F.array(
        *[flag(target == k) for k in (0, 1)],
        *[flag(tier == k) for k in (0, 1, 2)],
    )


def target_prior(df: DataFrame, flag: Column) -> float:
    return float(df.agg(F.avg(flag)).first()[0])
