"""Mixed-type table encoder and decoder as Column expressions.

Numbers are min-max scaled, categories one-hot. The fitted state (bounds and sorted levels)
is small and sits in expressions as literals, so encoding is one projection: no join,
no shuffle, no Python.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinsight.functions.frames import quoted
from twinsight.functions.numbers import as_number, category_key, check_supported, is_integral
from twinsight.operators.profile import infer_column_kinds

MAX_LEVELS = 100_000
_UNROLLED_LEVELS = 64  # up to here each slot is a compiled comparison


@dataclass(frozen=True)
class NumericColumn:
    name: str
    lo: float
    hi: float
    is_int: bool

    @property
    def width(self) -> float:
        return (self.hi - self.lo) or 1.0


@dataclass(frozen=True)
class CategoryColumn:
    name: str
    levels: tuple[str, ...]


_STATE_SCHEMA = (
    "position int, name string, kind string, lo double, hi double, is_int boolean, levels array<string>"
)


class TableEncoder:
    """Encoder with explicit column lists, or inferred ones via :meth:`infer`."""

    def __init__(self, categorical: Sequence[str] = (), numeric: Sequence[str] = ()):
        self.categorical = list(categorical)
        self.numeric = list(numeric)
        self.numeric_state: list[NumericColumn] = []
        self.category_state: list[CategoryColumn] = []

    @classmethod
    def infer(cls, df: DataFrame, target: str | None = None, **limits) -> TableEncoder:
        kinds = infer_column_kinds(df, target, **limits)
        dropped = [c for c, k in kinds.items() if k == "text"]
        if dropped:
            warnings.warn(f"free-text columns left out of the encoding: {dropped}", stacklevel=2)
        return cls(
            categorical=[c for c, k in kinds.items() if k == "categorical"],
            numeric=[c for c, k in kinds.items() if k == "numeric"],
        )

    # fitting

    def fit(self, df: DataFrame) -> TableEncoder:
        for c in self.numeric + self.categorical:
            check_supported(c, df.schema[c].dataType)
        self.numeric_state = self._fit_numeric(df)
        self.category_state = self._fit_levels(df)
        return self

    def _fit_numeric(self, df: DataFrame) -> list[NumericColumn]:
        if not self.numeric:
            return []
        row = numeric_bounds(df, self.numeric).first()
        state = []
        for i, c in enumerate(self.numeric):
            lo, hi = row[2 * i], row[2 * i + 1]
            if lo is None:
                warnings.warn(f"numeric column {c!r} holds no number; it encodes to 0", stacklevel=3)
                lo = hi = 0.0
            state.append(NumericColumn(c, float(lo), float(hi), is_integral(df.schema[c].dataType)))
        return state

    def _fit_levels(self, df: DataFrame) -> list[CategoryColumn]:
        if not self.categorical:
            return []
        limit = MAX_LEVELS * len(self.categorical)
        found = category_levels(df, self.categorical).limit(limit + 1).collect()
        levels: dict[str, list[str]] = {c: [] for c in self.categorical}
        for r in found:
            levels[r["name"]].append(r["level"])
        for c, values in levels.items():
            if len(values) > MAX_LEVELS or len(found) > limit:
                raise ValueError(f"column {c!r} has too many levels for a dense one-hot block; use SparseEncoder")
        return [CategoryColumn(c, tuple(sorted(levels[c]))) for c in self.categorical]

    @property
    def dim(self) -> int:
        return len(self.numeric_state) + sum(len(c.levels) for c in self.category_state)

    # encoding

    def scaled(self, df: DataFrame, state: NumericColumn) -> Column:
        """Min-max scaled number; a missing one sits at the midpoint, nothing is clipped."""
        x = as_number(quoted(state.name), df.schema[state.name].dataType)
        midpoint = (state.lo + state.hi) / 2
        return (F.coalesce(x, F.lit(midpoint)) - F.lit(state.lo)) / F.lit(state.width)

    def level_index(self, df: DataFrame, state: CategoryColumn) -> Column:
        """0-based level; an unseen value takes level 0."""
        key = category_key(quoted(state.name), df.schema[state.name].dataType)
        at = F.array_position(_texts(state.levels), key)
        return F.greatest(at - 1, F.lit(0)).cast("int")

    def one_hot(self, df: DataFrame, state: CategoryColumn) -> Column:
        if len(state.levels) > _UNROLLED_LEVELS:
            index = self.level_index(df, state)
            slots = F.sequence(F.lit(0), F.lit(len(state.levels) - 1))
            return F.transform(slots, lambda i: (i == index).cast("float"))
        key = category_key(quoted(state.name), df.schema[state.name].dataType)
        first, rest = state.levels[:1], state.levels[1:]
        unseen_or_first = ~key.isin(*rest) if rest else F.lit(True)
        slots = [unseen_or_first, *[key == level for level in rest]] if first else []
        return F.array(*[s.cast("float") for s in slots])

    def vector(self, df: DataFrame) -> Column:
        """``array<float>``: the numbers first, then one block per category."""
        blocks = []
        if self.numeric_state:
            blocks.append(F.array(*[self.scaled(df, s).cast("float") for s in self.numeric_state]))
        blocks += [self.one_hot(df, s) for s in self.category_state]
        if not blocks:
            return F.array().cast("array<float>")
        return F.concat(*blocks)

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, self.vector(df))

    def fit_transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return self.fit(df).transform(df, out)

    # decoding

    def decoded_columns(self, vector: Column) -> dict[str, Column]:
        """Columns back from a vector: clipped, rescaled, half-even rounded, or arg-maxed."""
        out = {}
        for i, s in enumerate(self.numeric_state):
            out[s.name] = decode_number(F.element_at(vector, i + 1), s)
        start = len(self.numeric_state) + 1
        for s in self.category_state:
            out[s.name] = decode_level(F.slice(vector, start, len(s.levels)), s.levels)
            start += len(s.levels)
        return out

    def inverse_transform(self, df: DataFrame, vector: str = "features", keep: Sequence[str] = ()) -> DataFrame:
        decoded = self.decoded_columns(quoted(vector))
        return df.select(*[quoted(c) for c in keep], *[c.alias(n) for n, c in decoded.items()])

    # state as a table

    def state_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for s in self.numeric_state:
            rows.append((len(rows), s.name, "numeric", s.lo, s.hi, s.is_int, None))
        for s in self.category_state:
            rows.append((len(rows), s.name, "categorical", None, None, None, list(s.levels)))
        return spark.createDataFrame(rows, _STATE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.state_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TableEncoder:
        encoder = cls()
        for r in spark.read.parquet(path).orderBy("position").collect():
            if r["kind"] == "numeric":
                encoder.numeric.append(r["name"])
                encoder.numeric_state.append(NumericColumn(r["name"], r["lo"], r["hi"], r["is_int"]))
            else:
                encoder.categorical.append(r["name"])
                encoder.category_state.append(CategoryColumn(r["name"], tuple(r["levels"])))
        return encoder


def _texts(levels: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in levels])


def numeric_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``<c>_lo`` and ``<c>_hi`` per column, from a single aggregate."""
    aggs = []
    for c in columns:
        x = as_number(quoted(c), df.schema[c].dataType)
        aggs += [F.min(x).alias(f"{c}_lo"), F.max(x).alias(f"{c}_hi")]
    return df.agg(*aggs)


def category_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct ``(name, level)`` pairs of all category columns in one pass."""
    pairs = [
        F.struct(F.lit(c).alias("name"), category_key(quoted(c), df.schema[c].dataType).alias("level"))
        for c in columns
    ]
    return df.select(F.inline(F.array(*pairs))).distinct()


def indexed_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(name, level, index)``, levels in text order from 0 (ranked over the distinct levels only)."""
    by_level = W.partitionBy("name").orderBy("level")
    return category_levels(df, columns).withColumn("index", F.row_number().over(by_level) - 1)


def decode_number(x: Column, state: NumericColumn) -> Column:
    value = F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)) * F.lit(state.width) + F.lit(state.lo)
    return F.rint(value).cast("long") if state.is_int else value


def decode_level(block: Column, levels: Sequence[str]) -> Column:
    """Label of the largest slot, the first one on ties."""
    return F.element_at(_texts(levels), F.array_position(block, F.array_max(block)).cast("int"))
