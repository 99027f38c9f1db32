"""Column profiling: kinds of the feature columns and the two labels of a target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import quoted
from twinsight.functions.numbers import as_number, category_key, check_supported, is_numeric

# Cardinality limits of the kind rule and the known positive labels, by priority.
NUMERIC_MIN_DISTINCT = 12
MAX_CARDINALITY = 40
POSITIVE_LABELS = ["Yes", "yes", "1", "True", "true", "churn", "Churn"]
DEFAULT_NEGATIVE = "No"

_HLL_ERROR = 0.05
_EXACT_BELOW = 2.0  # count exactly where the estimate is under twice the larger limit


@dataclass(frozen=True)
class Labels:
    negative: str
    positive: str


def distinct_counts(df: DataFrame, columns: list[str], exact_below: float) -> dict[str, int]:
    """Distinct non-missing values per column.

    One HyperLogLog pass sizes every column without a shuffle of values. Only columns whose
    estimate is small get an exact count.
    """
    if not columns:
        return {}
    values = {}
    for c in columns:
        dtype = df.schema[c].dataType
        values[c] = as_number(quoted(c), dtype) if dtype.typeName() in ("double", "float") else quoted(c)
    estimate = df.agg(
        *[F.approx_count_distinct(values[c], _HLL_ERROR).alias(f"n{i}") for i, c in enumerate(columns)]
    ).first()
    counts = {c: int(estimate[i]) for i, c in enumerate(columns)}
    close = [c for c in columns if counts[c] <= exact_below]
    if close:
        # These sets are known to be small, so they fit in the aggregate and no row is expanded.
        exact = df.agg(*[F.size(F.collect_set(values[c])).alias(f"n{i}") for i, c in enumerate(close)]).first()
        counts.update({c: int(exact[i]) for i, c in enumerate(close)})
    return counts


def infer_column_kinds(
    df: DataFrame, target: str | None = None, max_cardinality: int = MAX_CARDINALITY
) -> dict[str, str]:
    """``{column: "numeric" | "categorical" | "text"}`` in column order, the target left out.

    Numbers with more than 12 distinct values are numeric, any column with at most
    ``max_cardinality`` values is categorical, other numbers are numeric. What is left is
    free text: it has no numeric meaning, and the encoder drops it with a warning.
    """
    columns = [c for c in df.columns if c != target]
    for c in columns:
        check_supported(c, df.schema[c].dataType)
    counts = distinct_counts(df, columns, _EXACT_BELOW * max(max_cardinality, NUMERIC_MIN_DISTINCT))
    kinds = {}
    for c in columns:
        numeric = is_numeric(df.schema[c].dataType)
        if numeric and counts[c] > NUMERIC_MIN_DISTINCT:
            kinds[c] = "numeric"
        elif counts[c] <= max_cardinality:
            kinds[c] = "categorical"
        else:
            kinds[c] = "numeric" if numeric else "text"
    return kinds


def _target_key(df: DataFrame, target: str) -> Column:
    return category_key(quoted(target), df.schema[target].dataType)


def detect_labels(df: DataFrame, target: str) -> Labels:
    """Positive label by priority, negative the smallest other one; one aggregate, no level list."""
    key = _target_key(df, target)
    priority = F.coalesce(*[F.when(key == p, F.lit(i)) for i, p in enumerate(POSITIVE_LABELS)])
    row = (
        df.select(key.alias("label"), priority.alias("priority"))
        .agg(
            F.min("priority").alias("priority"),
            F.min("label").alias("lo"),
            F.max("label").alias("hi"),
            *[
                F.min(F.when(F.col("label") != p, F.col("label"))).alias(f"other{i}")
                for i, p in enumerate(POSITIVE_LABELS)
            ],
        )
        .first()
    )
    if row["lo"] is None:
        raise ValueError("the target column is empty")
    if row["priority"] is None:
        return Labels(negative=row["lo"], positive=row["hi"])
    other = row[f"other{row['priority']}"]
    return Labels(
        negative=DEFAULT_NEGATIVE if other is None else other, positive=POSITIVE_LABELS[row["priority"]]
    )


def binarise(df: DataFrame, target: str, labels: Labels) -> Column:
    """1.0 where the target reads as the positive label, else 0.0."""
    return (_target_key(df, target) == F.lit(labels.positive)).cast("double")


def label_text(flag: Column, labels: Labels) -> Column:
    """Back from 0/1 to label text."""
    return F.when(flag == 1, F.lit(labels.positive)).otherwise(F.lit(labels.negative))
