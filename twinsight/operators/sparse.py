"""Encoding of categories with any number of levels: a level dictionary as a table, rows as sparse vectors.

``TableEncoder`` keeps its levels as literals in an expression, which suits some thousands. Here the dictionary
is a table with one row per level, joined by level when encoding and by slot when decoding; neither the driver nor an
expression ever holds it. An encoded row lists the slots that are not zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise, quoted, rows_in_order
from twinsight.functions.numbers import category_key
from twinsight.operators.encoder import TableEncoder, decode_number


class SparseEncoder:
    """Numbers min-max scaled in the first slots, then a block of slots per category column, levels in text order.

    ``levels`` has ``position, level, slot``; ``blocks`` has ``(first slot, number of levels)`` per category column.
    """

    def __init__(self, categorical: Sequence[str] = (), numeric: Sequence[str] = ()):
        self.categorical = list(categorical)
        self.numbers = TableEncoder(numeric=list(numeric))
        self.levels: DataFrame | None = None
        self.blocks: list[tuple[int, int]] = []

    def fit(self, df: DataFrame) -> SparseEncoder:
        self.numbers.fit(df)
        keys = [F.struct(F.lit(i).alias("position"), self._key(df, c).alias("level")) for i, c in enumerate(self.categorical)]
        if not keys:
            return self
        found = df.select(F.inline(F.array(*keys))).distinct()
        ranked = rows_in_order(found, [F.col("position"), F.col("level")])
        slot = (F.col("rank") + len(self.numbers.numeric)).alias("slot")
        self.levels = materialise(ranked.select("position", "level", slot))
        rows = self.levels.groupBy("position").agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # a row a column
        by_position = {r["position"]: (r["first"], r["n"]) for r in rows}
        self.blocks = [by_position.get(i, (len(self.numbers.numeric), 0)) for i in range(len(self.categorical))]
        return self

    @property
    def dim(self) -> int:
        return len(self.numbers.numeric) + sum(n for _, n in self.blocks)

    def transform(self, df: DataFrame, slots: str = "slots", values: str = "values") -> DataFrame:
        """``df`` with the slots that are not zero, ascending, and their values. An unseen level takes its block's first slot."""
        out, at = df, []
        for i, c in enumerate(self.categorical):
            known = self.levels.filter(F.col("position") == i).select(F.col("level").alias(f"_level_{i}"), F.col("slot").alias(f"_slot_{i}"))
            out = out.join(known, self._key(df, c) == F.col(f"_level_{i}"), "left")
            at.append(F.coalesce(f"_slot_{i}", F.lit(self.blocks[i][0])))
        scaled = [self.numbers.scaled(df, state).cast("float") for state in self.numbers.numeric_state]
        # No lambda here: users may well put one over the slots, and Spark does not evaluate nested ones reliably.
        none = F.array().cast("array<struct<slot:bigint,value:float>>")
        cells = [F.array(F.struct(F.lit(i).cast("long").alias("slot"), x.alias("value"))) for i, x in enumerate(scaled)]
        cells = [F.when(x != 0, cell).otherwise(none) for x, cell in zip(scaled, cells, strict=True)]
        cells += [F.array(F.struct(x.cast("long").alias("slot"), F.lit(1.0).cast("float").alias("value"))) for x in at]
        filled = F.concat(none, *cells)
        columns = [quoted(c) for c in df.columns]
        return out.select(*columns, filled.alias("_cells")).select(*columns, F.col("_cells.slot").alias(slots), F.col("_cells.value").alias(values))

    def inverse_transform(self, df: DataFrame, slots: str = "slots", values: str = "values", keep: Sequence[str] = ()) -> DataFrame:
        """Columns back from sparse rows, as from dense ones: numbers clipped and rescaled, the first of the largest slots per block."""
        cells = F.arrays_zip(quoted(slots).alias("slot"), quoted(values).alias("value"))
        out = df.select(*[quoted(c) for c in keep], cells.alias("_cells"))
        names = []
        for i, state in enumerate(self.numbers.numeric_state):
            names.append((state.name, decode_number(_value_at("_cells", i), state)))
        out = out.withColumns({f"_slot_{i}": _largest(F.col("_cells"), first, n) for i, (first, n) in enumerate(self.blocks)}) if self.blocks else out
        for i, c in enumerate(self.categorical):
            known = self.levels.filter(F.col("position") == i).select(F.col("level").alias(f"_level_{i}"), F.col("slot").alias(f"_known_{i}"))
            out = out.join(known, F.col(f"_slot_{i}") == F.col(f"_known_{i}"), "left")
            names.append((c, F.col(f"_level_{i}")))
        return out.select(*[quoted(c) for c in keep], *[column.alias(name) for name, column in names])

    @staticmethod
    def _key(df: DataFrame, c: str) -> Column:
        return category_key(quoted(c), df.schema[c].dataType)


def _value_at(cells: str, slot: int) -> Column:
    listed = F.filter(cells, lambda cell: cell["slot"] == slot)
    return F.coalesce(F.get(listed, F.lit(0))["value"], F.lit(0.0))


def _largest(cells: Column, first: int, n: int) -> Column:
    """The first slot of a block that holds its largest value; slots not listed hold 0."""
    block = F.filter(cells, lambda cell: (cell["slot"] >= first) & (cell["slot"] < first + n))
    best = F.array_max(F.transform(block, lambda cell: F.struct(cell["value"].alias("value"), (-cell["slot"]).alias("before"))))
    top, at_top = best["value"], -best["before"]
    below = F.transform(F.filter(block, lambda cell: cell["value"] < 0), lambda cell: cell["slot"])
    # Some slot among the first (negative ones + 1) is 0 or not listed, unless the whole block is negative.
    last = F.least(F.size(below) + F.lit(first), F.lit(first + n - 1))
    zero = F.array_min(F.array_except(F.sequence(F.lit(first).cast("long"), last.cast("long")), below))
    return F.when(top > 0, at_top).otherwise(F.coalesce(zero, at_top))
