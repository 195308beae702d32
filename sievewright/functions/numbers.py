"""Numeric column expressions. NULL is the only missing value they let through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def to_number(col: Column) -> Column:
    """Text to double, NULL where it is not a number.

    The suffix test turns away Java float literals such as ``1.0d`` and ``1f``, which the
    cast would accept; ``inf`` is left alone. Only texts that end in such a letter pay for
    the pattern.
    """
    text = F.trim(col)
    suffixed = F.substring(text, -1, 1).isin("d", "D", "f", "F")
    return F.when(~(suffixed & text.rlike("[0-9.].$")), text.try_cast("double"))


def as_number(col: Column, dtype: T.DataType) -> Column:
    """Numeric coercion by declared type; booleans and nested types stay as they are."""
    if isinstance(dtype, T.StringType):
        return to_number(col)
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    if isinstance(dtype, (T.BooleanType, T.ArrayType, T.MapType, T.StructType)):
        return col
    return F.lit(None).cast("double")


def is_infinite(col: Column) -> Column:
    return col.isin(INF, -INF)


def finite(col: Column) -> Column:
    """The value if it is an ordinary number, else NULL (for NaN and both infinities)."""
    return F.when(~F.isnan(col) & ~is_infinite(col), col)


def clamp(col: Column, low: float | None, high: float | None) -> Column:
    """Clip into ``[low, high]``; NULL stays NULL although greatest/least skip NULLs."""
    if low is None or high is None:
        return col
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 for a zero denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
