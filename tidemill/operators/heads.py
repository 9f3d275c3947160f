"""First rows in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.functions.jsonsafe import json_rows
from tidemill.roles import data_columns, order_column

DATASET_PREVIEW = 15
PROFILE_PREVIEW = 10


def head_rows(df: DataFrame, n: int, order_by: str | None = None) -> DataFrame:
    """The first n rows, reading only the order column of all the others.

    The n-th smallest position is found on that one column; as a scalar subquery
    it is pushed into the scan, so row groups past it are skipped.  Rows without a
    position come last.
    """
    order = order_column(df, order_by)
    top = df.select(c(order).alias("o")).orderBy(F.asc_nulls_last("o")).limit(n)
    last = top.agg(F.max("o")).scalar()
    with_nulls = top.agg(F.count_if(F.col("o").isNull()) > 0).scalar()
    rows = df.filter((c(order) <= last) | (c(order).isNull() & with_nulls))
    return rows.orderBy(c(order).asc_nulls_last()).limit(n)


def numbered(df: DataFrame, order: str, name: str = "seq") -> DataFrame:
    """Number the rows of a small, already limited frame from 1."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(c(order))).cast("int"))


def preview(df: DataFrame, n: int = DATASET_PREVIEW, order_by: str | None = None) -> DataFrame:
    """First rows of a dataset."""
    return head_rows(df, n, order_by)


def preview_payload(df: DataFrame, n: int = DATASET_PREVIEW, order_by: str | None = None) -> DataFrame:
    """One row: columns, the first rows as JSON, and the size of the whole table."""
    order = order_column(df, order_by)
    names = data_columns(df)
    top = head_rows(df, n, order).select(c(order).alias("o"), json_rows(df.select(*[c(x) for x in names])).alias("row"))
    rows = top.agg(F.sort_array(F.collect_list(F.struct("o", "row"))).getField("row").alias("rows"))
    return rows.select(
        F.array(*[F.lit(x) for x in names]).alias("columns"),
        "rows",
        df.agg(F.count(F.lit(1))).scalar().alias("row_count"),
        F.lit(len(names)).alias("column_count"),
    )
