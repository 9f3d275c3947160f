"""Column roles, missing values and row order.

A column is *numeric* (any NumericType), or *categorical* (text, boolean, date,
timestamp).  Nested and binary columns have no role and are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.columns import c

#: Name of the row-position column added at ingest.  It rides along with the
#: data, fixes "first" and "head", and is never itself treated as data.
ROW = "_row"

TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)
_CATEGORICAL = (T.StringType, T.BooleanType, T.DateType, *TIMESTAMPS)
_FLOATING = (T.FloatType, T.DoubleType)


def data_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name != ROW]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_timestamp(dtype: T.DataType) -> bool:
    return isinstance(dtype, TIMESTAMPS)


def check_supported(df: DataFrame) -> None:
    bad = [
        f.name
        for f in df.schema.fields
        if f.name != ROW and not is_numeric(f.dataType) and not isinstance(f.dataType, _CATEGORICAL)
    ]
    if bad:
        raise TypeError(f"columns without a tabular type (nested or binary): {bad}")
    if ROW in df.columns and not isinstance(dtype_of(df, ROW), T.IntegralType):
        raise TypeError(f"the name {ROW!r} is kept for the row position, a whole number: rename the column")


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n in data_columns(df) if is_numeric(dtype_of(df, n))]


def categorical_columns(df: DataFrame) -> list[str]:
    return [n for n in data_columns(df) if not is_numeric(dtype_of(df, n))]


def text_columns(df: DataFrame) -> list[str]:
    return [n for n in data_columns(df) if is_text(dtype_of(df, n))]


def role(dtype: T.DataType) -> str:
    return "numeric" if is_numeric(dtype) else "categorical"


def normalise_missing(df: DataFrame) -> DataFrame:
    """Map NaN to NULL, so that every later step has one kind of missing value."""
    if not any(isinstance(f.dataType, _FLOATING) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.nullif(c(f.name), F.lit(float("nan")).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, _FLOATING)
            else c(f.name)
            for f in df.schema.fields
        ]
    )


def with_row_order(df: DataFrame) -> DataFrame:
    """Add the row position once, at ingest, in file and partition order.

    The value is stable for one layout of input files, so assign it before the
    first write and keep the stored column afterwards.
    """
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def order_column(df: DataFrame, order_by: str | None) -> str:
    """Name of the column that defines row order."""
    if order_by is None:
        if ROW not in df.columns:
            raise ValueError("row order is needed: pass order_by= or ingest with with_row_order()")
        return ROW
    if order_by not in df.columns:
        raise ValueError(f"order column {order_by!r} does not exist")
    return order_by


def replace_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Swap several columns in one projection, keeping the column order."""
    if not exprs:
        return df
    return df.select(*[exprs[n].alias(n) if n in exprs else c(n) for n in df.columns])
