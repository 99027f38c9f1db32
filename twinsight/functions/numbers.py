"""Number and text coercion as Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that a missing category is recorded under, by source type.
MISSING_NUMBER_TEXT = "nan"
MISSING_STRING_TEXT = "None"

# A JVM double also parses "12d" and "1.5f"; those are not numbers to a data user.
_TYPE_SUFFIX = r"[0-9.][dDfF]\s*$"


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans count as numeric features."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def check_supported(name: str, dtype: T.DataType) -> None:
    if not (is_numeric(dtype) or isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))):
        raise TypeError(
            f"column {name!r} has type {dtype.simpleString()}; cast it to a number or a string first"
        )


def as_number(column: Column, dtype: T.DataType) -> Column:
    """Double, with unparsable text and NaN both turned into null."""
    if isinstance(dtype, T.StringType):
        parsed = F.when(~column.rlike(_TYPE_SUFFIX), column.try_cast("double"))
    else:
        parsed = column.cast("double")
    return F.when(~F.isnan(parsed), parsed)


def coerce_numeric(column: Column, dtype: T.DataType, fill: float = 0.0) -> Column:
    """Double, with whatever is not a number replaced by ``fill``."""
    return F.coalesce(as_number(column, dtype), F.lit(float(fill)))


def _double_text(x: Column) -> Column:
    """Shortest decimal text; an exponent only outside [1e-4, 1e16), with a sign and two digits at least."""
    text = x.cast("string")
    size = F.abs(x)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), F.lit(r"\.0$"), F.lit(""))
    power = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0"))
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), digits)
    infinite = F.when(x > 0, "inf").otherwise("-inf")
    text = F.when(size == float("inf"), infinite).when((size >= 1e16) | ((size < 1e-4) & (size > 0)), scientific).otherwise(text)
    exponent_form = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    plain = F.rtrim(x.cast("decimal(38,20)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.when(exponent_form, plain).otherwise(text)


def category_key(column: Column, dtype: T.DataType) -> Column:
    """Text key of a category; a missing value becomes a level of its own."""
    if isinstance(dtype, T.BooleanType):
        text = F.initcap(column.cast("string"))
        return F.coalesce(text, F.lit(MISSING_STRING_TEXT))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = F.when(~F.isnan(column), _double_text(column))
        return F.coalesce(text, F.lit(MISSING_NUMBER_TEXT))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(column.cast("string"), F.lit(MISSING_NUMBER_TEXT))
    return F.coalesce(column.cast("string"), F.lit(MISSING_STRING_TEXT))
