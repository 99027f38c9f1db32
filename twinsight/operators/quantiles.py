"""Exact linear-interpolated quantiles that never gather a column in one task.

``percentile`` keeps every distinct value in one reducer. Here the two order statistics around each
quantile are bracketed with ``percentile_approx``, at every table size, so a result does not depend on it. A second pass counts the rows of every bracketed value and of the gaps
between brackets, which proves or refutes the bracket and settles the order statistics. On very
large tables the brackets are first narrowed until they hold few distinct values. Every pass is
a map-side-combined aggregate with a small result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import join_by_group, materialise, quoted, sums_before

BRACKET_VALUES = 20_000
READ_VALUES = 500_000  # over all groups and probabilities
MAX_GROUPS = 1_000
_ACCURACY = 10_000
_SLACK = 2.0 / _ACCURACY

Quantiles = dict[str, list[float]]


@dataclass
class _Rank:
    """Search state of one order statistic: the value is known, or lies in [lo, hi]."""

    rank: int
    lo: float
    hi: float
    value: float | None = None
    below: int = 0  # rows with value <= lo
    inside: int = 0  # rows strictly between lo and hi
    values: int = 0  # about how many distinct values those rows have


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    group: str | None = None,
) -> Quantiles:
    """``{group: [quantile per prob]}``; without ``group`` the only key is ``""``.

    Missing values must be gone beforehand. Groups are few by contract (populations, tiers).
    """
    key = F.lit("") if group is None else quoted(group).cast("string")
    rows = df.select(key.alias("g"), quoted(value).cast("double").alias("v"))
    probs = [float(p) for p in probs]

    around = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-_SLACK, _SLACK)]
    head = (
        rows.groupBy("g")
        .agg(
            F.count("v").alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.percentile_approx("v", around, _ACCURACY).alias("q"),
        )
        .limit(MAX_GROUPS + 1)
        .collect()
    )
    if len(head) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups for exact quantiles")
    head = [r for r in head if r["n"]]
    if not head:
        return {}
    extremes = {r["g"]: (float(r["lo"]), float(r["hi"])) for r in head}
    search: dict[str, list[_Rank]] = {}
    for r in head:
        ranks = []
        for i, p in enumerate(probs):
            lo, hi = float(r["q"][2 * i]), float(r["q"][2 * i + 1])
            at = (r["n"] - 1) * p
            ranks += [_Rank(math.floor(at), lo, hi), _Rank(math.ceil(at), lo, hi)]
        search[r["g"]] = ranks

    # The sketch keeps a bracket to about 2 * _SLACK of the rows: read it at once if that is little.
    budget = min(BRACKET_VALUES, max(READ_VALUES // (len(head) * len(probs)), 100))
    narrow = max(r["n"] for r in head) * 2 * _SLACK > budget
    if not narrow and not _settle(rows, search):
        narrow = True
    while narrow:
        if _count_brackets(rows, search, extremes):
            continue  # a bracket was widened and must be counted again
        wide = [s for ranks in search.values() for s in ranks if s.value is None and s.values > budget]
        if not wide:
            _settle(rows, search)
            break
        _narrow_brackets(rows, search)

    out: Quantiles = {}
    for r in head:
        ranks = search[r["g"]]
        result = []
        for i, p in enumerate(probs):
            a, b = ranks[2 * i].value, ranks[2 * i + 1].value
            at = (r["n"] - 1) * p
            result.append(a if a == b else a + (b - a) * (at - math.floor(at)))
        out[r["g"]] = result
    return out


def _per_group(values: dict[str, float]) -> Column:
    """The literal that belongs to the row's group (few groups, so a literal map)."""
    if len(values) == 1:
        return F.lit(next(iter(values.values())))
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col("g"))


def _bound(search: dict[str, list[_Rank]], i: int, side: str) -> Column:
    return _per_group({g: float(getattr(ranks[i], side)) for g, ranks in search.items()})


def _count_brackets(
    rows: DataFrame, search: dict[str, list[_Rank]], extremes: dict[str, tuple[float, float]]
) -> bool:
    """Exact counts around every open bracket; settles ranks that fall on a bracket end.

    True if a sketch missed its rank and the bracket had to be widened.
    """
    widened = False
    v = F.col("v")
    width = len(next(iter(search.values())))
    aggs = []
    for i in range(width):
        lo, hi = _bound(search, i, "lo"), _bound(search, i, "hi")
        inside = (v > lo) & (v < hi)
        aggs += [
            F.count_if(v < lo).alias(f"lt{i}"),
            F.count_if(v <= lo).alias(f"le{i}"),
            F.count_if(inside).alias(f"in{i}"),
            F.count_if(v <= hi).alias(f"top{i}"),
            F.approx_count_distinct(F.when(inside, v)).alias(f"d{i}"),
        ]
    for r in rows.groupBy("g").agg(*aggs).collect():
        if r["g"] not in search:
            continue
        for i, s in enumerate(search[r["g"]]):
            if s.value is not None:
                continue
            if not r[f"lt{i}"] <= s.rank < r[f"top{i}"]:
                lo, hi = extremes[r["g"]]
                s.lo, s.hi = (lo, s.lo) if s.rank < r[f"lt{i}"] else (s.hi, hi)
                widened = True
            elif s.rank < r[f"le{i}"]:
                s.value = s.lo
            elif s.rank >= r[f"le{i}"] + r[f"in{i}"]:
                s.value = s.hi
            else:
                s.below, s.inside, s.values = r[f"le{i}"], r[f"in{i}"], r[f"d{i}"]
    return widened


def _narrow_brackets(rows: DataFrame, search: dict[str, list[_Rank]]) -> None:
    """Replace each open bracket by approximate quantiles of its interior around the rank."""
    v = F.col("v")
    for_group = {}
    width = len(next(iter(search.values())))
    aggs = []
    for i in range(width):
        inside = (v > _bound(search, i, "lo")) & (v < _bound(search, i, "hi"))
        # One grid of probabilities serves all groups; each picks its two neighbours.
        aggs.append(
            F.percentile_approx(F.when(inside, v), [k / 1000.0 for k in range(1001)], _ACCURACY).alias(f"q{i}")
        )
    for r in rows.groupBy("g").agg(*aggs).collect():
        for_group[r["g"]] = r
    for g, ranks in search.items():
        for i, s in enumerate(ranks):
            grid = for_group[g][f"q{i}"]
            if s.value is not None or grid is None:
                continue
            at = (s.rank - s.below + 0.5) / max(s.inside, 1) * 1000.0
            k_lo, k_hi = max(math.floor(at) - 2, 0), min(math.ceil(at) + 2, 1000)
            if k_lo > 0:
                s.lo = float(grid[k_lo])
            if k_hi < 1000:
                s.hi = float(grid[k_hi])


def _settle(rows: DataFrame, search: dict[str, list[_Rank]]) -> bool:
    """Pick the order statistics by cumulative count over bracketed values and gaps.

    Values inside a bracket keep themselves, all others collapse to the bracket end below
    them, so one grouped count holds everything needed. False if some rank lies in a gap.
    """
    v = F.col("v")
    width = len(next(iter(search.values())))
    inside, below = F.lit(False), F.lit(float("-inf"))
    for i in range(width):
        lo, hi = _bound(search, i, "lo"), _bound(search, i, "hi")
        inside = inside | ((v >= lo) & (v <= hi))
        below = F.greatest(below, F.when(v > hi, hi).otherwise(F.lit(float("-inf"))))
    snapped = rows.select("g", inside.alias("kept"), F.when(inside, v).otherwise(below).alias("v"))
    found: dict[str, list[tuple[float, bool, int]]] = {}
    for r in snapped.groupBy("g", "kept", "v").count().collect():
        found.setdefault(r["g"], []).append((float(r["v"]), not r["kept"], int(r["count"])))
    for g, ranks in search.items():
        ordered = sorted(found.get(g, []))
        for s in ranks:
            if s.value is not None:
                continue
            seen = 0
            for x, is_gap, n in ordered:
                seen += n
                if seen > s.rank:
                    s.value = None if is_gap else x
                    break
            if s.value is None:
                return False
    return True


def group_quantiles(df: DataFrame, value: str, probs: Sequence[float], group: str, out: str = "quantiles") -> DataFrame:
    """``group, n, out``: exact quantiles (linear interpolation) of any number of groups, as a table.

    Equal values of a group are merged first, so a hot value is one row. All groups lie in one order of (group, value), whose
    running counts are sums over range partitions: a group with a third of all rows spans many parts, a million small
    ones share one. A row then knows which order statistics it covers, and one aggregate picks them.

    Missing and NaN values are left out; a group without any has no row. A null group is one of its own.
    """
    rows = df.select(quoted(group).alias("g"), quoted(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    # 0.0 and -0.0 are one value
    merged = rows.withColumn("v", F.col("v") + F.lit(0.0)).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    placed = materialise(sums_before(merged, [F.col("g"), F.col("v")], F.col("c"), "before"))
    groups = materialise(placed.groupBy("g").agg(F.min("before").alias("start"), F.sum("c").alias("n")))
    met = join_by_group(placed, groups, "g", F.col("v"), ["start", "n"]).withColumn("first", F.col("before") - F.col("start"))
    parts, picked = [], []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        for name, rank in ((f"lo{i}", F.floor(at)), (f"hi{i}", F.ceil(at))):
            covers = (F.col("first") <= rank) & (rank < F.col("first") + F.col("c"))
            parts.append(F.max(F.when(covers, F.col("v"))).alias(name))
        lo, hi, gap = F.col(f"lo{i}"), F.col(f"hi{i}"), at - F.floor(at)
        # As exact_quantiles does it: from the nearer end, and a value that both ends share as it is.
        picked.append(F.when(lo == hi, lo).when(gap < 0.5, lo + (hi - lo) * gap).otherwise(hi - (hi - lo) * (1 - gap)))
    found = met.groupBy("g", "n").agg(*parts)
    return found.select(F.col("g").alias(group), "n", F.array(*picked).alias(out))
