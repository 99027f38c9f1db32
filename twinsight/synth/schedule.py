"""Noise schedule and the two closed-form diffusion steps.

The formulas are plain arithmetic, so the same function serves NumPy arrays inside tasks and
Column expressions outside.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Linear variance schedule, and the clamp on the estimate of the clean row.
BETA_FIRST = 1e-4
BETA_LAST = 0.02
CLEAN_CLAMP = 3.0


def alpha_bars(steps: int) -> np.ndarray:
    """Share of signal variance left after each step."""
    return np.cumprod(1.0 - np.linspace(BETA_FIRST, BETA_LAST, steps))


def schedule_table(spark: SparkSession, steps: int) -> DataFrame:
    """``(t, beta, alpha_bar)``, one row per step; the running product is over ``steps`` rows."""
    width = (BETA_LAST - BETA_FIRST) / max(steps - 1, 1)
    beta = F.lit(BETA_FIRST) + F.col("id") * F.lit(width)
    so_far = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return (
        spark.range(0, steps, 1, 1)
        .select(F.col("id").alias("t"), beta.alias("beta"))
        .withColumn("alpha_bar", F.exp(F.sum(F.log(1 - F.col("beta"))).over(so_far)))
    )


def add_noise(x, eps, signal, noise):
    """Noised value: ``signal`` is sqrt(alpha_bar), ``noise`` is sqrt(1 - alpha_bar)."""
    return signal * x + noise * eps


def clean_estimate(x, eps, signal, noise):
    """The clean value that the predicted noise implies."""
    return (x - noise * eps) / signal


def noised_array(x: Column, eps: Column, alpha_bar: Column) -> Column:
    signal, noise = F.sqrt(alpha_bar), F.sqrt(1 - alpha_bar)
    return F.zip_with(x, eps, lambda a, e: add_noise(a, e, signal, noise))


def reverse_step_array(x: Column, eps: Column, alpha_bar: Column, alpha_bar_before: Column) -> Column:
    """One reverse step on arrays; ``alpha_bar_before`` is 1 at the last one, which returns the estimate."""
    signal, noise = F.sqrt(alpha_bar), F.sqrt(1 - alpha_bar)
    signal_before, noise_before = F.sqrt(alpha_bar_before), F.sqrt(1 - alpha_bar_before)

    def one(a: Column, e: Column) -> Column:
        clean = F.least(F.greatest(clean_estimate(a, e, signal, noise), F.lit(-CLEAN_CLAMP)), F.lit(CLEAN_CLAMP))
        return add_noise(clean, e, signal_before, noise_before)

    return F.zip_with(x, eps, one)
