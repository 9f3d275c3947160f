"""Text forms of values, as used for labels, text conversion and CSV output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.columns import c
from tidemill.roles import dtype_of, is_timestamp

NULL_LABEL = "nan"
NULL_TIME_LABEL = "NaT"

#: Length of the printed timestamp for each finest unit in a column.
_TIME_WIDTH = {"day": 10, "second": 19, "milli": 23, "micro": 26}


def float_text(col: Column) -> Column:
    """Shortest decimal text: plain from 1e-4 up to 1e16, else like ``1.5e+16``."""
    text = col.cast("double").cast("string")
    size = F.abs(col.cast("double"))
    plain = F.regexp_replace(
        F.regexp_replace(text.try_cast("decimal(38,22)").cast("string"), r"0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(
        F.abs(power).cast("string")
    )
    scientific = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), digits)
    return (
        F.when(size == F.lit(float("inf")), F.when(col > 0, "inf").otherwise("-inf"))
        .when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def time_text(col: Column, unit: str) -> Column:
    """Timestamp text down to a unit (day, second, milli or micro)."""
    text = col.cast("string")
    if unit in ("milli", "micro"):
        text = F.rpad(F.when(text.contains("."), text).otherwise(F.concat(text, F.lit("."))), 26, "0")
    return F.substring(text, 1, _TIME_WIDTH[unit])


def value_text(col: Column, dtype: T.DataType, unit: str = "micro") -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return float_text(col)
    if is_timestamp(dtype):
        return time_text(col, unit)
    return col.cast("string")


def value_label(col: Column, dtype: T.DataType, unit: str = "micro", null_label: str | None = None) -> Column:
    """Text of a value, with missing values shown as a label of their own."""
    missing = null_label or (NULL_TIME_LABEL if is_timestamp(dtype) else NULL_LABEL)
    return F.coalesce(value_text(col, dtype, unit), F.lit(missing))


def time_units(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Finest time unit used in each timestamp column (one narrow aggregate job)."""
    times = [n for n in names if is_timestamp(dtype_of(df, n))]
    if not times:
        return {}
    facts = []
    for i, name in enumerate(times):
        seconds = F.extract(F.lit("SECOND"), c(name))
        micros = (seconds * 1_000_000).cast("bigint")
        level = (
            F.when(micros % 1000 != 0, 3)
            .when(micros % 1_000_000 != 0, 2)
            .when((micros != 0) | (F.minute(c(name)) != 0) | (F.hour(c(name)) != 0), 1)
            .otherwise(0)
        )
        facts.append(F.max(F.when(c(name).isNotNull(), level)).alias(f"u{i}"))
    found = df.agg(*facts).first()
    units = list(_TIME_WIDTH)
    return {name: units[found[i] or 0] for i, name in enumerate(times)}


def label_columns(df: DataFrame, names: list[str], null_label: str | None = None) -> dict[str, Column]:
    units = time_units(df, names)
    return {n: value_label(c(n), dtype_of(df, n), units.get(n, "micro"), null_label) for n in names}
