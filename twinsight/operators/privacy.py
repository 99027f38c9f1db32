"""Privacy and novelty of a synthetic table: membership inference and near-duplicate share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise, merge_one_row_frames
from twinsight.operators.auc import roc_auc
from twinsight.operators.features import (
    FeatureSpace,
    distinct_rows,
    encode_internal,
    internal_space,
    joint_space,
    squared_distance,
)
from twinsight.operators.neighbours import nearest_distance

# Duplicate tolerance, risk bands and gate limits.
DUPLICATE_TOLERANCE = 1e-6
LOW_RISK_BELOW = 0.55
MODERATE_RISK_BELOW = 0.7
LOW_RISK = "low (safe)"
MODERATE_RISK = "moderate"
HIGH_RISK = "high (unsafe)"
NOVELTY_ABOVE = 0.99


def member_distances(train: DataFrame, synth: DataFrame, holdout: DataFrame) -> DataFrame:
    """Distinct real tuples with member / non-member counts and distance to the nearest synthetic row."""
    space = joint_space(synth, train, holdout)
    found = _member_distances(train, synth, holdout, space)
    return found.toDF(*space.columns, *found.columns[len(space.columns) :])


def _member_distances(train: DataFrame, synth: DataFrame, holdout: DataFrame, space: FeatureSpace) -> DataFrame:
    """The same under generated feature names: feature columns, n_member, n_other, distance."""
    inner = internal_space(space)
    real = encode_internal(train, space).withColumn("member", F.lit(1)).unionByName(
        encode_internal(holdout, space).withColumn("member", F.lit(0))
    )
    queries = distinct_rows(real, inner, n_member=F.col("member"), n_other=1 - F.col("member"))
    index = distinct_rows(encode_internal(synth, space), inner)
    found = nearest_distance(queries, index, inner, payload=("n_member", "n_other"))
    return found.select(*inner.columns, "n_member", "n_other", "distance")


def membership_scores(train: DataFrame, synth: DataFrame, holdout: DataFrame) -> DataFrame:
    """``(score, n_member, n_other)``: attack score = minus distance, closer means likelier a member.

    Distances are compared as they are, whatever the unit of the numbers.
    """
    scored = _member_distances(train, synth, holdout, joint_space(synth, train, holdout))
    score = (-F.col("distance")).alias("score")
    return scored.groupBy(score).agg(F.sum("n_member").alias("n_member"), F.sum("n_other").alias("n_other"))


def membership_inference_auc(train: DataFrame, synth: DataFrame, holdout: DataFrame) -> DataFrame:
    """One row with the AUC of the distance attack: 0.5 is safe, near 1 means memorised."""
    scores = materialise(membership_scores(train, synth, holdout))
    return roc_auc(scores, "score", "n_member", "n_other", out="membership_inference_auc")


def novelty_rate(real: DataFrame, synth: DataFrame, tol: float = DUPLICATE_TOLERANCE) -> DataFrame:
    """One row: share of synthetic rows with no real row within ``tol``.

    Below sqrt(2) no category may differ, so a near-duplicate agrees on every category and
    falls into the same or a touching grid cell in every number: a hash join on all of them.
    A wider tolerance is answered from nearest-neighbour distances.
    """
    outer = joint_space(real, synth)
    space = internal_space(outer)
    made, seen = encode_internal(synth, outer), encode_internal(real, outer)
    rows, known = distinct_rows(made, space, n=F.lit(1)), distinct_rows(seen, space)
    if tol >= math.sqrt(2.0):
        near = nearest_distance(rows, known, space, payload=("n",))
        novel = F.when(F.col("distance") > tol, F.col("n")).otherwise(0)
        return near.agg((F.sum(novel) / F.sum("n")).alias("novelty_rate"))
    copied = near_duplicates(rows, known, space, tol)
    counts = merge_one_row_frames(
        made.agg(F.count(F.lit(1)).alias("_all")), copied.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_copied"))
    )
    return counts.select(((F.col("_all") - F.col("_copied")) / F.col("_all")).alias("novelty_rate"))


def near_duplicates(rows: DataFrame, known: DataFrame, space: FeatureSpace, tol: float) -> DataFrame:
    """The distinct ``rows`` (feature columns and ``n``) that have a ``known`` row within ``tol`` (< sqrt 2).

    A number falls into a cell a few tolerances wide, or as wide as its own magnitude needs where doubles are
    too coarse for that: an outlier coarsens its own cell only. An infinite value is near to nothing.
    """
    known = known.select(*[F.col(c).alias(f"ix_{c}") for c in space.columns])
    on = [F.col(c) == F.col(f"ix_{c}") for c in space.categorical]
    if tol <= 0 or not space.numeric:
        on += [F.col(c) == F.col(f"ix_{c}") for c in space.numeric]
        return rows.join(known, on, "left_semi")

    width = (4.0 if len(space.numeric) <= 2 else 64.0) * tol
    for i, c in enumerate(space.numeric):
        known = known.withColumn(f"ix_scale{i}", _scale(F.col(f"ix_{c}"), width))
        known = known.withColumn(f"ix_cell{i}", _cell(F.col(f"ix_{c}"), F.col(f"ix_scale{i}"), width))
        # The scales and cells that [x - tol, x + tol] touches: nearly always one of each.
        low, high = F.col(c) - F.lit(1.5 * tol), F.col(c) + F.lit(1.5 * tol)
        crosses = F.when((low < 0) & (high > 0), 0)
        at_low, at_high = _scale(low, width), _scale(high, width)
        first = F.least(at_low, at_high, crosses)
        rows = rows.withColumn(f"scale{i}", F.explode(F.sequence(first, F.greatest(at_low, at_high))))
        cells = F.sequence(_cell(low, F.col(f"scale{i}"), width), _cell(high, F.col(f"scale{i}"), width))
        rows = rows.withColumn(f"cell{i}", F.explode(cells))
        on += [F.col(f"scale{i}") == F.col(f"ix_scale{i}"), F.col(f"cell{i}") == F.col(f"ix_cell{i}")]
    within = squared_distance(space, "", "ix_") <= F.lit(tol * tol)
    hits = rows.join(known, [*on, within], "left_semi")
    return hits.select(*space.columns, "n").distinct()


def _scale(x: Column, width: float) -> Column:
    """0 where cells of ``width`` can tell doubles apart, else how often the width is doubled for this magnitude."""
    coarse = F.ceil(F.log2(F.abs(x) * F.lit(1e-9 / width)))
    return F.greatest(F.lit(0), F.coalesce(F.when(F.abs(x) < float("inf"), coarse), F.lit(0))).cast("int")


def _cell(x: Column, scale: Column, width: float) -> Column:
    """Grid cell; the grid is shifted off round numbers, where real data piles up."""
    return F.floor(x / (F.lit(width) * F.pow(F.lit(2.0), scale)) + F.lit(0.381966))


def risk_band(auc: Column) -> Column:
    return (
        F.when(auc < LOW_RISK_BELOW, LOW_RISK).when(auc < MODERATE_RISK_BELOW, MODERATE_RISK).otherwise(HIGH_RISK)
    )


def three_axis_report(train: DataFrame, synth: DataFrame, holdout: DataFrame) -> DataFrame:
    """One row: AUC, its risk band, novelty rate, and whether both pass the gate."""
    row = merge_one_row_frames(membership_inference_auc(train, synth, holdout), novelty_rate(train, synth))
    auc, novelty = F.col("membership_inference_auc"), F.col("novelty_rate")
    return row.select(
        auc,
        risk_band(auc).alias("membership_inference_risk"),
        novelty,
        ((auc < LOW_RISK_BELOW) & (novelty > NOVELTY_ABOVE)).alias("passes_privacy"),
    )


def deployment_gate(report: DataFrame, summary: DataFrame) -> DataFrame:
    """Privacy report and decision-fidelity summary in one row."""
    return merge_one_row_frames(summary, report)
