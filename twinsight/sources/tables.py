"""Table sources.

Any DataFrame is a valid input to the library; these are the two readers most users need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from twinsight.functions.frames import quoted
from twinsight.functions.numbers import coerce_numeric

_BY_SUFFIX = {"parquet": "parquet", "orc": "orc", "json": "json", "csv": "csv", "gz": "csv"}


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read a file or folder of files; CSV is read as text with a header unless typed by ``schema``."""
    fmt = fmt or _BY_SUFFIX.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def load_clean(df: DataFrame, id_columns: Sequence[str], number_columns: Sequence[str]) -> DataFrame:
    """Drop identifier columns (ignored if absent) and turn text columns into numbers, blanks to 0."""
    out = df.drop(*id_columns)
    return out.withColumns(
        {c: coerce_numeric(quoted(c), out.schema[c].dataType) for c in number_columns if c in out.columns}
    )
