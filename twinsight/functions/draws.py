"""Keyed pseudo-random draws.

A draw is a pure function of (key, salt), so it does not depend on partitioning, row
order or task retries, and any engine with MD5 can reproduce it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13
_SCALE = float(16**_HEX_DIGITS)
_POISSON_TERMS = 18  # P(K >= 18 | mean 1) is below the 2**-52 grid of the uniform


def draw_hash(key: Column, salt: str) -> Column:
    """32 hex digits, uniform over keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{salt}")))


def keyed_uniform(key: Column, salt: str) -> Column:
    """Uniform in (0, 1) on a 2**-52 grid."""
    digits = F.substring(draw_hash(key, salt), 1, _HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_SCALE)


def keyed_normal(key: Column, salt: str) -> Column:
    """Standard normal (Box-Muller on two keyed uniforms)."""
    u1 = keyed_uniform(key, f"{salt}:r")
    u2 = keyed_uniform(key, f"{salt}:a")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def poisson_chunks(mean: Column) -> Column:
    """Number of equal parts a Poisson mean is cut into so that each part is at most 1."""
    return F.greatest(F.ceil(mean), F.lit(1)).cast("long")


def poisson_from_uniform(u: str, mean: str) -> Column:
    """Inverse Poisson CDF at column ``u`` for a column ``mean`` of at most 1.

    A chain of comparisons with the cumulative sums, each in Horner form: the first two or
    three settle nearly every row, and the chain ends where the sum reaches 1 in doubles.
    """
    chain = []
    for k in range(_POISSON_TERMS):
        total = "1D"
        for j in range(k, 0, -1):
            total = f"(1D + {mean} / {j}D * {total})"
        chain.append(f"WHEN {u} <= exp(-{mean}) * {total} THEN {k}")
    return F.expr(f"CASE {' '.join(chain)} ELSE {_POISSON_TERMS} END")
