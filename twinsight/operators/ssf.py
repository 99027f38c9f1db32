"""Strategy simulation fidelity: do two populations lead to the same campaign decisions?

For every strategy (segment, discount, threshold) the expected return on investment over the
flagged customers decides go or no-go. The discount never changes who is flagged, and the
return is affine in it, so three sums per (population, tier, score bucket) answer any number
of strategies: the customer rows are aggregated once, whatever the size of the family.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import astuple, dataclass
from functools import cached_property
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinsight.functions.frames import join_by_group, materialise, quoted, running_sums, sums_before
from twinsight.operators.quantiles import exact_quantiles, group_quantiles
from twinsight.operators.scorers import Scorer, apply_scorer
from twinsight.operators.value import TERCILES, tier_name

# The default grid of 48 strategies.
SEGMENTS = ["high", "mid", "low", "all"]
DISCOUNTS = [0.05, 0.10, 0.15, 0.20]
THRESHOLDS = [0.30, 0.50, 0.70]

_WHEN_CHAIN_LIMIT = 64
_FAMILY_COLUMNS = ["segment", "discount", "threshold"]


@dataclass(frozen=True)
class Strategy:
    """Contact customers of ``segment`` scoring at least ``threshold`` with ``discount``."""

    segment: str
    discount: float
    threshold: float


@dataclass(frozen=True)
class CampaignEconomics:
    # Default campaign economics.
    retention_offer_cost: float = 15.0
    success_rate: float = 0.30
    value_recoverable: float = 0.30
    fp_redemption: float = 0.30


def default_strategy_family() -> list[Strategy]:
    return [Strategy(*cell) for cell in product(SEGMENTS, DISCOUNTS, THRESHOLDS)]


def strategy_table(
    spark: SparkSession, family: DataFrame | Sequence[Strategy] | None = None
) -> DataFrame:
    """The family as a table with a ``copies`` count, so that a repeated strategy keeps its weight."""
    if isinstance(family, DataFrame):
        typed = [F.col(c).cast(t) for c, t in zip(_FAMILY_COLUMNS, ("string", "double", "double"))]
        return family.select(*typed).groupBy(*_FAMILY_COLUMNS).agg(F.count(F.lit(1)).alias("copies"))
    counts = Counter(astuple(s) for s in (family or default_strategy_family()))
    segments, discounts, thresholds = zip(*counts)
    columns = [
        pa.array(segments, pa.string()),
        pa.array(discounts, pa.float64()),
        pa.array(thresholds, pa.float64()),
        pa.array(counts.values(), pa.int64()),
    ]
    return spark.createDataFrame(pa.table(columns, names=[*_FAMILY_COLUMNS, "copies"]))


def score_population(
    df: DataFrame, scorer: Scorer, value_col: str, name: str | Column, on_missing: str = "error"
) -> DataFrame:
    """``(population, prob, value)`` with a strictly numeric value; ``name`` is one population or a column that tells them apart.

    A missing value has no place in a tercile: it raises at run time, or is dropped on request.
    """
    if on_missing not in ("error", "drop"):
        raise ValueError("on_missing must be 'error' or 'drop'")
    value = quoted(value_col).cast("double")
    scored = apply_scorer(df, scorer).select(
        (F.lit(name) if isinstance(name, str) else name).alias("population"), F.col("prob").cast("double").alias("prob"), value.alias("value")
    )
    missing = F.col("value").isNull() | F.isnan("value")
    if on_missing == "drop":
        return scored.filter(~missing)
    message = F.lit(f"column {value_col} has missing values; clean them or pass on_missing='drop'")
    return scored.withColumn("value", F.when(missing, F.raise_error(message)).otherwise(F.col("value")))


def add_tiers(populations: DataFrame) -> DataFrame:
    """Add ``tier`` by the terciles of each population's own values."""
    cuts = exact_quantiles(populations, "value", TERCILES, group="population")
    if not cuts:
        return populations.withColumn("tier", F.lit("low"))
    t1 = F.element_at(F.create_map(*[F.lit(x) for g, q in cuts.items() for x in (g, q[0])]), F.col("population"))
    t2 = F.element_at(F.create_map(*[F.lit(x) for g, q in cuts.items() for x in (g, q[1])]), F.col("population"))
    return populations.withColumn("tier", tier_name(F.col("value"), t1, t2))


def _few_thresholds(family: DataFrame) -> list[float] | None:
    """The distinct thresholds where a chain of cases can hold them, else none."""
    rows = family.select("threshold").filter("threshold IS NOT NULL").distinct().limit(_WHEN_CHAIN_LIMIT + 1).collect()
    return sorted(r["threshold"] for r in rows) if len(rows) <= _WHEN_CHAIN_LIMIT else None


def _usable_score() -> Column:
    """A NaN or missing score reaches no threshold."""
    return F.col("prob").isNotNull() & ~F.isnan("prob")


def _sums_by(tiered: DataFrame, key: str) -> DataFrame:
    """The one pass over the customers: n, sum(p v), sum((1-p) v) per population, tier and ``key``."""
    p, v = F.col("prob"), F.col("value")
    return tiered.groupBy("population", "tier", key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p * v).alias("hit_value"), F.sum((1 - p) * v).alias("miss_value")
    )


def _by_segment(by_tier: DataFrame) -> DataFrame:
    """Segment "all" is the sum of the tiers."""
    segments = F.explode(F.array(F.col("tier"), F.lit("all"))).alias("segment")
    return by_tier.select("population", segments, "bucket", "n", "hit_value", "miss_value")


def bucket_sums(tiered: DataFrame, family: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Sums per population, segment and bucket; the family with its ``level``; whether the levels are many.

    A strategy flags the buckets from its level up. The bucket of a score is the number of thresholds that it reaches; rows
    below every threshold are never flagged and go. Few thresholds are a chain of cases, so that at most
    ``4 * (thresholds + 1)`` rows per population leave the aggregate over the customers. Many are merged with the scores in
    one order, dealt by range: customers are first summed by score, and nothing of the family goes to the driver.
    """
    thresholds = _few_thresholds(family)
    if thresholds is not None:
        chain = F.when(~_usable_score(), F.lit(0))
        for i in range(len(thresholds), 0, -1):
            chain = chain.when(F.col("prob") >= F.lit(thresholds[i - 1]), F.lit(i))
        by_tier = _sums_by(tiered.withColumn("bucket", chain.otherwise(F.lit(0))).filter("bucket > 0"), "bucket")
        ranks = [F.when(F.col("threshold") == F.lit(t), F.lit(i)) for i, t in enumerate(thresholds, 1)]
        return _by_segment(by_tier), family.withColumn("level", F.coalesce(*ranks, F.lit(None).cast("int"))), False
    scores = _sums_by(tiered.filter(_usable_score()), "prob").withColumnRenamed("prob", "point")
    asked = family.select(F.col("threshold").alias("point")).filter("point IS NOT NULL").distinct()
    # At one point the threshold comes before the scores: they reach it.
    line = asked.withColumn("reaches", F.lit(0)).unionByName(scores.withColumn("reaches", F.lit(1)), allowMissingColumns=True)
    order = [F.col(c) for c in ("point", "reaches", "population", "tier")]
    placed = sums_before(line, order, (1 - F.col("reaches")).cast("long"), "bucket")
    levels = placed.filter("reaches = 0").select(F.col("point").alias("threshold"), (F.col("bucket") + 1).alias("level"))
    sums = placed.filter("reaches = 1 AND bucket > 0").groupBy("population", "tier", "bucket")
    by_tier = sums.agg(*[F.sum(c).alias(c) for c in ("n", "hit_value", "miss_value")])
    return _by_segment(by_tier), family.join(levels, "threshold", "left"), True


def _running_sums(sums: DataFrame, family: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sums over all buckets from each asked level up, so that a strategy meets one row and not many.

    Zero rows make sure every asked (population, segment, level) is there.
    """
    asked = family.filter(F.col("segment").isin(SEGMENTS) & F.col("level").isNotNull()).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("population"), "segment", F.col("level").alias("bucket")
    ).distinct()
    zero = {"n": F.lit(0).cast("long"), "hit_value": F.lit(0.0), "miss_value": F.lit(0.0)}
    keys = ["population", "segment", "bucket"]
    filled = sums.unionByName(asked.withColumns(zero)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in zero])
    return running_sums(filled, ["population", "segment"], [F.desc("bucket")], list(zero))


def strategy_returns(
    populations: DataFrame,
    names: Sequence[str],
    family: DataFrame,
    econ: CampaignEconomics | None = None,
) -> DataFrame:
    """One row per distinct strategy: ``copies`` and an array ``returns`` in the order of ``names``.

    ``populations`` has columns population, prob, value; ``family`` comes from
    :func:`strategy_table`. Each element is (population, n_flagged, roi); a strategy that flags
    nobody has a return of 0.
    """
    econ = econ or CampaignEconomics()
    sums, family, many = bucket_sums(add_tiers(populations), family)
    reached = F.col("bucket") >= F.col("level")
    if many:
        sums, reached = _running_sums(sums, family, names), F.col("bucket") == F.col("level")
    sums = sums.withColumnRenamed("segment", "_segment")
    met = family.join(
        sums,
        (F.col("segment") == F.col("_segment")) & reached,
        "left",
    )
    aggs = []
    for i, name in enumerate(names):
        for c, zero in (("n", F.lit(0)), ("hit_value", F.lit(0.0)), ("miss_value", F.lit(0.0))):
            part = F.sum(F.when(F.col("population") == name, F.col(c)))
            aggs.append(F.coalesce(part, zero).alias(f"{c}{i}"))
    totals = met.groupBy(*_FAMILY_COLUMNS, "copies").agg(*aggs)

    def one(i: int, name: str) -> Column:
        saved = F.col(f"hit_value{i}") * F.lit(econ.value_recoverable * econ.success_rate) * (1 - F.col("discount"))
        waste = F.col(f"miss_value{i}") * F.col("discount") * F.lit(econ.fp_redemption)
        cost = F.col(f"n{i}") * F.lit(float(econ.retention_offer_cost))
        return F.struct(
            F.lit(name).alias("population"), F.col(f"n{i}").alias("n_flagged"), (saved - waste - cost).alias("roi")
        )

    returns = F.array(*[one(i, name) for i, name in enumerate(names)])
    return totals.select(*_FAMILY_COLUMNS, "copies", returns.alias("returns"))


def strategy_roi(
    populations: DataFrame,
    names: Sequence[str],
    family: DataFrame,
    econ: CampaignEconomics | None = None,
) -> DataFrame:
    """``(segment, discount, threshold, population, n_flagged, roi)`` per strategy and population."""
    returns = strategy_returns(populations, names, family, econ)
    return returns.select(*_FAMILY_COLUMNS, F.inline("returns"))


def decision(roi: Column) -> Column:
    """1 for a strictly positive return; NaN is no decision to go."""
    return ((roi > 0) & ~F.isnan(roi)).cast("int")


REAL = "real"


def compare_decisions(returns: DataFrame) -> DataFrame:
    """Real (first in ``returns``) against every candidate, one row per candidate and listed strategy."""
    others = F.slice("returns", 2, F.size("returns") - 1)
    pairs = returns.select(
        *_FAMILY_COLUMNS, F.col("returns")[0]["roi"].alias("roi_real"), "copies", F.explode(others).alias("other")
    )
    rows = pairs.select(
        F.col("other.population").alias("candidate"),
        *_FAMILY_COLUMNS,
        "roi_real",
        F.col("other.roi").alias("roi_syn"),
        decision(F.col("roi_real")).alias("decision_real"),
        decision(F.col("other.roi")).alias("decision_syn"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
    gap = F.abs(F.col("roi_real") - F.col("roi_syn")) / F.greatest(F.abs("roi_real"), F.lit(1.0))
    return rows.withColumn("agree", F.col("decision_real") == F.col("decision_syn")).withColumn("roi_gap", gap)


def summarise(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    agree = F.col("agree").cast("int")
    aggs = [
        F.avg(agree).alias("ssf"),
        F.count(F.lit(1)).alias("n_strategies"),
        F.sum(agree).alias("n_agree"),
        (F.avg("roi_gap") * 100).alias("mean_roi_gap_pct"),
        F.sum("decision_real").alias("n_go_real"),
        F.sum("decision_syn").alias("n_go_syn"),
    ]
    out = compared.groupBy(*by).agg(*aggs) if by else compared.agg(*aggs)
    spread = (F.col("n_go_real") > 0) & (F.col("n_go_real") < F.col("n_strategies"))
    return out.withColumn("is_discriminating", spread)


class FidelityResult:
    """Per-strategy table, one-row summary, and scalars by name (``result["ssf"]``).

    ``compared`` is the lazy plan over the populations. Whatever is read first settles it: the
    strategy rows are written once, and everything else is derived from those few rows.
    """

    PER_STRATEGY = [
        "segment",
        "discount",
        "threshold",
        "roi_real",
        "roi_syn",
        "decision_real",
        "decision_syn",
        "agree",
    ]

    def __init__(self, compared: DataFrame):
        self.compared = compared

    @cached_property
    def _settled(self) -> DataFrame:
        return materialise(self.compared)

    @property
    def per_strategy(self) -> DataFrame:
        return self._settled.select(*self.PER_STRATEGY)

    @property
    def summary(self) -> DataFrame:
        return summarise(self._settled)

    @cached_property
    def _values(self) -> dict:
        return self.summary.first().asDict()

    def __getitem__(self, name: str):
        if name == "per_strategy":
            return [r.asDict() for r in self.per_strategy.collect()]
        return self._values[name]

    def to_dict(self) -> dict:
        return {**self._values, "per_strategy": self["per_strategy"]}


def ssf_score(
    real: DataFrame,
    synthetic: DataFrame,
    scorer: Scorer,
    value_col: str,
    strategy_family: DataFrame | Sequence[Strategy] | None = None,
    econ: CampaignEconomics | None = None,
    on_missing: str = "error",
) -> FidelityResult:
    """Share of strategies with the same go / no-go decision on both populations."""
    compared = compare_candidates(
        real, {"synthetic": synthetic}, scorer, value_col, strategy_family, econ, on_missing
    )
    return FidelityResult(compared)


def compare_candidates(
    real: DataFrame,
    candidates: Mapping[str, DataFrame],
    scorer: Scorer,
    value_col: str,
    strategy_family: DataFrame | Sequence[Strategy] | None = None,
    econ: CampaignEconomics | None = None,
    on_missing: str = "error",
) -> DataFrame:
    """Per-strategy rows of several synthetic populations against one real one, in one aggregate."""
    if REAL in candidates:
        raise ValueError(f"a candidate may not be called {REAL!r}")
    populations = score_population(real, scorer, value_col, REAL, on_missing)
    for name, df in candidates.items():
        populations = populations.unionByName(score_population(df, scorer, value_col, name, on_missing))
    family = strategy_table(real.sparkSession, strategy_family)
    return compare_decisions(strategy_returns(populations, [REAL, *candidates], family, econ))


#: (segment, threshold) pairs of a family that may be compared by key: each is a row per candidate.
_KEYED_PAIRS = 10_000


def compare_by_key(
    real: DataFrame,
    synthetic: DataFrame,
    candidate: str,
    scorer: Scorer,
    value_col: str,
    strategy_family: DataFrame | Sequence[Strategy] | None = None,
    econ: CampaignEconomics | None = None,
    on_missing: str = "error",
) -> DataFrame:
    """Per-strategy rows of as many synthetic populations as column ``candidate`` tells apart, against one real one.

    The candidate is a key like any other: terciles, bucket sums and returns are grouped by it, and the real side is joined
    by strategy. The plan is the same for two candidates and for a million. A null candidate is one of its own.
    """
    econ = econ or CampaignEconomics()
    family = strategy_table(real.sparkSession, strategy_family)
    key = quoted(candidate).cast("string")
    named = F.when(key.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), key))  # no candidate is called like the real one
    populations = score_population(real, scorer, value_col, REAL, on_missing).unionByName(
        score_population(synthetic, scorer, value_col, named, on_missing)
    )
    cuts = materialise(group_quantiles(populations, "value", TERCILES, "population", "cuts"))
    met = join_by_group(populations, cuts, "population", F.struct("value", "prob"), ["cuts"])  # the real side is as large as all candidates
    tiered = met.withColumn("tier", tier_name(F.col("value"), F.col("cuts")[0], F.col("cuts")[1]))
    sums, family, _ = bucket_sums(tiered, family)
    asked = family.filter(F.col("segment").isin(SEGMENTS)).select("segment", F.col("level").alias("bucket")).distinct().limit(_KEYED_PAIRS + 1).collect()
    if len(asked) > _KEYED_PAIRS:
        raise ValueError(f"more than {_KEYED_PAIRS} pairs of segment and threshold to compare by key")
    zero = {"n": F.lit(0).cast("long"), "hit_value": F.lit(0.0), "miss_value": F.lit(0.0)}
    pairs = F.array(*[F.struct(F.lit(r["segment"]).alias("segment"), F.lit(r["bucket"]).alias("bucket")) for r in asked])
    # Every population has a row for every pair, flagged customers or not.
    filled = sums.unionByName(cuts.select("population", F.inline(pairs)).withColumns(zero))
    keys = ["population", "segment", "bucket"]
    filled = filled.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in zero])
    from_level_up = W.partitionBy("population", "segment").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, 0)
    totals = filled.select(*keys, *[F.sum(c).over(from_level_up).alias(c) for c in zero]).withColumnRenamed("bucket", "level")
    saved = F.col("hit_value") * F.lit(econ.value_recoverable * econ.success_rate) * (1 - F.col("discount"))
    waste = F.col("miss_value") * F.col("discount") * F.lit(econ.fp_redemption)
    roi = saved - waste - F.col("n") * F.lit(float(econ.retention_offer_cost))
    returns = family.join(totals, ["segment", "level"]).select("population", *_FAMILY_COLUMNS, "copies", roi.alias("roi"))
    returns = materialise(returns)
    ours = returns.filter(F.col("population") == REAL).select(*_FAMILY_COLUMNS, F.struct(F.lit(REAL).alias("population"), "roi").alias("real"))
    both = returns.filter(F.col("population") != REAL).join(ours, _FAMILY_COLUMNS)
    name = F.when(F.col("population") != "null", F.expr("substring(population, 2)"))
    pair = F.array("real", F.struct(name.alias("population"), "roi"))
    return compare_decisions(both.select(*_FAMILY_COLUMNS, "copies", pair.alias("returns")))
