"""The whole cleaning run: fixed step order, few jobs, one report."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.operators import cleaning as steps
from tidemill.operators.counting import constant_facts
from tidemill.operators.duplicates import COPIES, drop_duplicates
from tidemill.operators.quantiles import outlier_bounds
from tidemill.roles import (
    categorical_columns,
    check_supported,
    data_columns,
    normalise_missing,
    numeric_columns,
)
from tidemill.session import stage

@dataclass(frozen=True)
class CleanSpec:
    """What to clean.  The defaults fill gaps and remove duplicates, nothing else."""

    drop_columns: tuple[str, ...] = ()
    fill_missing: str = "median"
    fill_categorical: str = "mode"
    remove_duplicates: bool = True
    trim_whitespace: bool = False
    normalize_headers: bool = False
    text_case: str = "none"
    drop_missing_rows: bool = False
    drop_empty_columns: bool = False
    drop_constant_columns: bool = False
    remove_outliers: bool = False
    cap_outliers: bool = False
    outlier_column: str | None = None
    convert_column: str | None = None
    convert_type: str | None = None
    round_numeric: bool = False
    round_digits: int = 2
    target_column: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.round_digits <= 8:
            raise ValueError("round_digits must be between 0 and 8")


@dataclass
class CleanResult:
    frame: DataFrame
    summary: dict[str, Any]
    target_column: str | None = None
    fills: dict[str, steps.Fill] = field(default_factory=dict)

    def summary_frame(self) -> DataFrame:
        """The report as one row; nested parts are JSON text."""
        flat = {k: json.dumps(v) if isinstance(v, (list, dict)) else v for k, v in self.summary.items()}
        kinds = {bool: "boolean", int: "bigint", str: "string"}
        schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in flat.items())
        return self.frame.sparkSession.createDataFrame([tuple(flat.values())], schema)


def _facts(df: DataFrame, names: list[str], constant: bool) -> tuple[int, dict[str, int], list[str]]:
    """Row count, missing values per column and (if asked) constant columns, in one job."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(c(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)]
    if constant:
        aggs += [f.alias(f"k{i}") for i, f in enumerate(constant_facts(df, names))]
    row = df.agg(*aggs).first()
    missing = {n: row[f"m{i}"] for i, n in enumerate(names)}
    return row["rows"], missing, [n for i, n in enumerate(names) if constant and row[f"k{i}"]]


def clean(df: DataFrame, spec: CleanSpec = CleanSpec(), order_by: str | None = None) -> CleanResult:
    """Run the cleaning steps in their fixed order.

    ``order_by`` names a data column giving row order where the table carries no
    ``_row`` column; it is needed only for date conversion.  The returned frame
    is lazy.  Statistics come from a handful of aggregate jobs; after
    deduplication the rows are staged once, so that its shuffle is not repeated.
    """
    check_supported(df)
    df = normalise_missing(df)
    columns_before = data_columns(df)

    # Expressions only: trim, blank to null, headers, case, conversion.
    if spec.trim_whitespace:
        df = steps.trim_text(df)
    df = steps.blanks_to_null(df)
    headers: dict[str, str] | None = None
    if spec.normalize_headers:
        df, headers = steps.normalise_headers(df)

    def current(name: str | None) -> str | None:
        return (headers or {}).get(name, name)

    outlier_column, to_convert = current(spec.outlier_column), current(spec.convert_column)
    df = steps.change_case(df, spec.text_case)
    converting = bool(to_convert and spec.convert_type and to_convert in data_columns(df))
    if converting:
        df = steps.convert_column(df, to_convert, spec.convert_type, current(order_by))

    # One job for everything that decides which columns stay.
    names = data_columns(df)
    rows_before, missing, constant = _facts(df, names, spec.drop_constant_columns)
    conversion = None
    if converting:
        cells = {
            "number": lambda: rows_before - missing[to_convert],
            "date": lambda: rows_before - missing[to_convert],
            "string": lambda: rows_before,
        }.get(spec.convert_type, lambda: 0)()
        conversion = {"column": to_convert, "target_type": spec.convert_type, "converted_cells": cells}
    empty = [n for n in names if missing[n] == rows_before] if spec.drop_empty_columns else []
    constant = [n for n in constant if n not in empty]
    gone = {*empty, *constant}
    dropped = [n for n in dict.fromkeys(current(n) for n in spec.drop_columns) if n in names and n not in gone]
    df = steps.drop_columns(df, [*gone, *dropped])
    names = data_columns(df)
    missing = {n: missing[n] for n in names}

    # Rows.  Deduplication is the only shuffle of whole rows.
    rows, rows_dropped, duplicates = rows_before, 0, 0
    if spec.drop_missing_rows and any(missing.values()):
        df = steps.drop_missing_rows(df)
        missing = dict.fromkeys(names, 0)
        if not spec.remove_duplicates:
            rows = df.count()
            rows_dropped = rows_before - rows
    if spec.remove_duplicates and names:
        df = stage(drop_duplicates(df, COPIES, rows_before), "dedup")
        rows, missing, before = _after_dedup(df, names)
        duplicates, rows_dropped = before - rows, rows_before - before
        df = df.drop(COPIES)

    # Fill values are computed only for columns that have gaps.
    numeric = [n for n in numeric_columns(df) if missing[n]]
    categorical = [n for n in categorical_columns(df) if missing[n]]
    fills = steps.numeric_fills(df, numeric, spec.fill_missing, {n: rows - missing[n] for n in numeric})
    fills |= steps.categorical_fills(df, categorical, spec.fill_categorical)
    df = steps.apply_fills(df, fills)
    missing = {n: 0 if n in fills else missing[n] for n in names}

    # Outliers.
    removed = capped = 0
    wanted = spec.remove_outliers or spec.cap_outliers
    if wanted and steps.check_outlier_column(df, outlier_column):
        value = c(outlier_column).cast("double")
        bounds = outlier_bounds(df, value, rows - missing[outlier_column])
        if bounds is not None and spec.remove_outliers:
            df = steps.remove_outliers(df, outlier_column, bounds)
            rows_kept, missing, _ = _facts(df, names, constant=False)
            removed, rows = rows - rows_kept, rows_kept
        elif bounds is not None:
            # A missing value counts as changed, as it never equals itself.
            capped = df.agg(F.count_if(F.coalesce(~value.between(*bounds), F.lit(True)))).first()[0]
            df = steps.cap_outliers(df, outlier_column, bounds)

    if spec.round_numeric:
        df = steps.round_numeric(df, spec.round_digits)

    summary = {
        "rows_before": rows_before,
        "rows_after": rows,
        "columns_before": columns_before,
        "columns_after": names,
        "dropped_columns": dropped,
        "empty_columns_dropped": empty,
        "constant_columns_dropped": constant,
        "duplicates_removed": duplicates,
        "missing_rows_dropped": rows_dropped,
        "missing_after": sum(missing.values()),
        "fill_missing": spec.fill_missing,
        "fill_categorical": spec.fill_categorical,
        "trim_whitespace": spec.trim_whitespace,
        "normalize_headers": spec.normalize_headers,
        "text_case": spec.text_case,
        "header_map": headers,
        "outlier_column": outlier_column,
        "outliers_removed": removed,
        "outliers_capped": capped,
        "round_numeric": spec.round_numeric,
        "round_digits": spec.round_digits,
        "conversion": conversion,
    }
    return CleanResult(df, summary, current(spec.target_column), fills)


def _after_dedup(df: DataFrame, names: list[str]) -> tuple[int, dict[str, int], int]:
    """Rows kept, their missing values, and the rows they stood for."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("before"),
        *[F.count_if(c(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)],
    ).first()
    return row["rows"], {n: row[f"m{i}"] for i, n in enumerate(names)}, row["before"]

