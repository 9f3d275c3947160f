"""Stored datasets: load, save as a new version, register."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.columns import c
from tidemill.functions import dates, numbers
from tidemill.functions.labels import time_units, value_text
from tidemill.operators.cleaning import first_value
from tidemill.roles import check_supported, data_columns, dtype_of, is_text, is_timestamp, replace_columns
from tidemill.sources import csv

CATALOG = (
    "id bigint, project_id bigint, name string, file_path string, row_count bigint, "
    "column_count bigint, target_column string, created_at timestamp_ntz"
)

# Type names in a schema sidecar.
_SIDECAR_NAMES = {
    T.LongType: "int64",
    T.IntegerType: "int32",
    T.ShortType: "int16",
    T.ByteType: "int8",
    T.DoubleType: "float64",
    T.FloatType: "float32",
    T.BooleanType: "bool",
    T.StringType: "string",
}
# What type names in a sidecar ask for.
_PARTS = {"datetime": "time", "int": "number", "float": "number"}
_TEXT_NAMES = ("string", "object")


def sidecar(df: DataFrame) -> dict[str, str]:
    """``{column: type name}`` of a frame."""

    def name(dtype: T.DataType) -> str:
        if is_timestamp(dtype) or isinstance(dtype, T.DateType):
            return "datetime64[ns]"
        if isinstance(dtype, T.DecimalType) and (dtype.precision, dtype.scale) == (20, 0):
            return "uint64"
        return _SIDECAR_NAMES.get(type(dtype), "float64")

    return {n: name(dtype_of(df, n)) for n in data_columns(df)}


def _sidecar_path(path: str) -> str:
    base = path.rstrip("/")
    return (base[: -len(".csv")] if base.lower().endswith(".csv") else base) + ".schema.json"


def write_sidecar(df: DataFrame, path: str) -> None:
    text = json.dumps(sidecar(df), indent=2)
    one = df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)
    one.write.mode("overwrite").text(_sidecar_path(path))


def read_sidecar(spark: SparkSession, path: str) -> dict[str, str]:
    """The sidecar next to a dataset; a missing or unreadable one is ignored."""
    try:
        rows = spark.read.text(_sidecar_path(path), wholetext=True).collect()  # one small file
    except AnalysisException as error:  # any other failure to read it is not passed over
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    try:
        found = json.loads("".join(r["value"] for r in rows))
    except ValueError:
        return {}
    return {str(k): str(v) for k, v in found.items()} if isinstance(found, dict) else {}


def _kind(type_name: str) -> str | None:
    """What a sidecar type name asks for; capitalised and other names ask for nothing."""
    if type_name in _TEXT_NAMES:
        return "text"
    return next((kind for part, kind in _PARTS.items() if part in type_name), None)


def apply_schema(df: DataFrame, schema: dict[str, str], order_by: str | None = None) -> DataFrame:
    """Coerce columns to the named types; absent columns and other names are left alone."""
    wanted = {n: kind for n, t in schema.items() if n in data_columns(df) and (kind := _kind(t))}
    units = time_units(df, [n for n, kind in wanted.items() if kind == "text"])

    def coerced(name: str, kind: str) -> Column:
        dtype = dtype_of(df, name)
        if kind == "text":
            return value_text(c(name), dtype, units.get(name, "micro"))
        if kind == "number":
            return c(name) if isinstance(dtype, T.NumericType) else numbers.to_number(c(name), dtype)
        fmt = dates.guess_format(first_value(df, name, order_by)) if is_text(dtype) else None
        return dates.to_timestamp(c(name), dtype, fmt)

    return replace_columns(df, {n: coerced(n, kind) for n, kind in wanted.items()})


def load_dataset(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Load a dataset: Parquet as stored, CSV with inference and its sidecar schema."""
    kind = file_format or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    if kind == "csv":
        return apply_schema(csv.read_csv(spark, path), read_sidecar(spark, path))
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError("a dataset is either CSV or Parquet")


def save_dataset(df: DataFrame, root: str, preserve_types: bool = True) -> str:
    """Write a new version under ``root`` and return its path.

    A dataset is never overwritten in place, as the new version may still be
    reading the old one; the catalog row is pointed at the returned path.
    """
    version = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    if preserve_types:
        path = version + ".parquet"
        df.write.parquet(path)
    else:
        path = version + ".csv"
        csv.write_csv(df, path)
        write_sidecar(df, path)
    return path


def register(datasets: Sequence[tuple[str, DataFrame]], targets: dict[str, str] | None = None) -> DataFrame:
    """``name, row_count, column_count, target_column`` for several datasets, counted in one job."""
    rows = None
    for name, df in datasets:
        check_supported(df)
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("name"),
            "row_count",
            F.lit(len(data_columns(df))).cast("bigint").alias("column_count"),
            F.lit((targets or {}).get(name)).cast("string").alias("target_column"),
        )
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no dataset to register")
    return rows
