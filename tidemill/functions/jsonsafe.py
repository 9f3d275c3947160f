"""Values that can be written as plain JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.columns import c
from tidemill.functions.numbers import finite_or_null
from tidemill.roles import is_timestamp


def iso_text(col: Column) -> Column:
    """ISO-8601 with a T, and microseconds only where there are any."""
    text = F.replace(col.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)


def json_safe(col: Column, dtype: T.DataType) -> Column:
    """Non-finite numbers to NULL, timestamps to ISO text, through nested types."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite_or_null(col)
    if is_timestamp(dtype):
        return iso_text(col)
    if isinstance(dtype, T.DateType):
        return F.concat(col.cast("string"), F.lit("T00:00:00"))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda item: json_safe(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, item: json_safe(item, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [json_safe(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col


def json_safe_frame(df: DataFrame) -> DataFrame:
    return df.select(*[json_safe(c(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def json_rows(df: DataFrame) -> Column:
    """One JSON object per row, with missing values written as null."""
    safe = [json_safe(c(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return F.to_json(F.struct(*safe), {"ignoreNullFields": "false"})
