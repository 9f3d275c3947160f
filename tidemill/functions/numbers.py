"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts accepted as numbers.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY = r"(?i)^[+-]?inf(inity)?$"


def number_text(col: Column) -> Column:
    """Text without the ASCII white space that may surround a number."""
    return F.trim(col, F.lit(" \t\n\r\f\v"))


def text_to_number(col: Column) -> Column:
    """Parse decimal text to double; anything else becomes NULL."""
    text = number_text(col)
    return (
        F.when(text.rlike(NUMBER), text.try_cast("double"))
        .when(text.rlike(INFINITY), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def time_to_number(col: Column) -> Column:
    """Nanoseconds since the epoch, by the wall clock of the value."""
    days = F.datediff(col.cast("date"), F.lit("1970-01-01").cast("date"))
    whole = (days * 24 + F.hour(col)) * 60 + F.minute(col)
    return (whole.cast("double") * 60 + F.extract(F.lit("SECOND"), col).cast("double")) * 1e9


def to_number(col: Column, dtype: T.DataType) -> Column:
    """Coerce a column to double; text that is no number becomes NULL."""
    if isinstance(dtype, T.StringType):
        return text_to_number(col)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return time_to_number(col.cast("timestamp_ntz"))
    return col.cast("double")


def round_half_even(col: Column, digits: int) -> Column:
    """Scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def round_column(col: Column, dtype: T.DataType, digits: int) -> Column:
    if isinstance(dtype, T.IntegralType):
        return col
    if isinstance(dtype, T.DecimalType):
        return F.bround(col, digits).cast(dtype)
    return round_half_even(col.cast("double"), digits).cast(dtype)


def finite_or_null(col: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(F.abs(col) < F.lit(float("inf")), col)


def null_safe_clip(col: Column, lower: float, upper: float) -> Column:
    return F.when(col < lower, F.lit(lower)).when(col > upper, F.lit(upper)).otherwise(col)
