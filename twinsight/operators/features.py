"""Common feature space of several tables, as columns (no one-hot matrix is ever built).

Every level of the joint encoding is known, so each differing category adds exactly 2 to a
squared one-hot distance: |x - y|^2 = sum (x_i - y_i)^2 + 2 * (number of differing categories).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsight.functions.frames import quoted
from twinsight.functions.numbers import category_key, check_supported, coerce_numeric, is_numeric
from twinsight.operators.encoder import category_levels


@dataclass(frozen=True)
class FeatureSpace:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def joint_space(*frames: DataFrame) -> FeatureSpace:
    """Columns all frames share, in the first one's order; numeric only if numeric everywhere."""
    types_by_name: dict[str, list[T.DataType]] = {}
    for frame in frames:
        for column in frame.schema:
            types_by_name.setdefault(column.name, []).append(column.dataType)
    parts: dict[bool, list[str]] = {True: [], False: []}
    for name, types in types_by_name.items():
        if len(types) < len(frames):
            continue
        for dtype in types:
            check_supported(name, dtype)
        parts[all(map(is_numeric, types))].append(name)
    if not parts[True] and not parts[False]:
        raise ValueError("the tables have no column in common")
    return FeatureSpace(tuple(parts[True]), tuple(parts[False]))


def joint_encode(df: DataFrame, space: FeatureSpace, keep: list[str] | None = None) -> DataFrame:
    """The frame in the joint space: unscaled numbers (missing to 0) and text keys."""
    columns = [coerce_numeric(quoted(c), df.schema[c].dataType).alias(c) for c in space.numeric]
    columns += [category_key(quoted(c), df.schema[c].dataType).alias(c) for c in space.categorical]
    return df.select(*columns, *[quoted(c) for c in keep or []])


def internal_space(space: FeatureSpace) -> FeatureSpace:
    """The same space under generated names, which no helper column of an operator can clash with."""
    return FeatureSpace(
        tuple(f"number{i}" for i in range(len(space.numeric))), tuple(f"category{i}" for i in range(len(space.categorical)))
    )


def encode_internal(df: DataFrame, space: FeatureSpace, keep: list[str] | None = None) -> DataFrame:
    """``joint_encode`` with the feature columns under the names of ``internal_space``."""
    return joint_encode(df, space, keep).toDF(*internal_space(space).columns, *(keep or []))


def joint_levels(space: FeatureSpace, *frames: DataFrame) -> DataFrame:
    """Distinct ``(name, level)`` over the union of all frames; each frame is deduplicated first."""
    levels = [category_levels(f, space.categorical) for f in frames]
    union = levels[0]
    for other in levels[1:]:
        union = union.unionByName(other)
    return union.distinct()


def distinct_rows(encoded: DataFrame, space: FeatureSpace, **weights: Column) -> DataFrame:
    """One row per distinct feature tuple with summed weights.

    The partial aggregate runs before the shuffle, so a tuple that makes up a third of the
    table leaves each task as a single row.
    """
    if not weights:
        return encoded.select(*space.columns).distinct()
    return encoded.groupBy(*space.columns).agg(*[F.sum(w).alias(n) for n, w in weights.items()])


def squared_distance(space: FeatureSpace, left: str, right: str) -> Column:
    """Squared distance between the tuples in columns ``<left><c>`` and ``<right><c>``."""
    total = F.lit(0.0)
    for c in space.numeric:
        diff = F.col(f"{left}{c}") - F.col(f"{right}{c}")
        total = total + diff * diff
    for c in space.categorical:
        total = total + F.when(F.col(f"{left}{c}") == F.col(f"{right}{c}"), F.lit(0.0)).otherwise(F.lit(2.0))
    return total
