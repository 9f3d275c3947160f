"""The steps of the cleaning pipeline, each a plain DataFrame transformation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.columns import c
from tidemill.functions import dates, numbers, text
from tidemill.functions.labels import time_units, value_text
from tidemill.operators.counting import column_modes, constant_facts
from tidemill.operators.quantiles import exact_quantiles
from tidemill.roles import (
    ROW,
    categorical_columns,
    data_columns,
    dtype_of,
    is_text,
    numeric_columns,
    order_column,
    replace_columns,
    text_columns,
)

# --- text ------------------------------------------------------------------


def trim_text(df: DataFrame) -> DataFrame:
    return replace_columns(df, {n: text.strip(c(n)) for n in text_columns(df)})


def blanks_to_null(df: DataFrame) -> DataFrame:
    return replace_columns(df, {n: text.blank_to_null(c(n)) for n in text_columns(df)})


def change_case(df: DataFrame, case: str) -> DataFrame:
    if case not in text.TEXT_CASES:
        return df
    return replace_columns(df, {n: text.text_case(c(n), case) for n in text_columns(df)})


# --- headers ---------------------------------------------------------------


def normalised_headers(names: Sequence[str]) -> list[str]:
    """Headers of lower-case word characters; the n-th of equal ones is numbered n, or the next number that is free."""
    words = [re.sub(r"\W", "", re.sub(" ", "_", name.strip().lower())) or "column" for name in names]
    copies: Counter[str] = Counter()
    headers: dict[str, int] = {}
    for place, word in enumerate(words):
        copies[word] += 1
        number = copies[word]
        while (header := word if number == 1 else f"{word}_{number}") in headers:
            number += 1
        headers[header] = place
    return list(headers)


def normalise_headers(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names = data_columns(df)
    renamed = dict(zip(names, normalised_headers(names)))
    return df.select(*[c(n).alias(renamed.get(n, n)) for n in df.columns]), renamed


# --- type conversion -------------------------------------------------------


def convert_column(df: DataFrame, column: str | None, to: str | None, order_by: str | None = None) -> DataFrame:
    """Coerce one column to ``number``, ``string`` or ``date``; unknown names change nothing."""
    if not column or column not in data_columns(df):
        return df
    dtype = dtype_of(df, column)
    if to == "number":
        new = numbers.to_number(c(column), dtype)
    elif to == "string":
        unit = time_units(df, [column]).get(column, "micro")
        new = value_text(c(column), dtype, unit)
    elif to == "date":
        fmt = dates.guess_format(first_value(df, column, order_by)) if is_text(dtype) else None
        new = dates.to_timestamp(c(column), dtype, fmt)
    else:
        return df
    return replace_columns(df, {column: new})


def first_value(df: DataFrame, column: str, order_by: str | None) -> str | None:
    """The first non-null value in row order (a top-1, no global sort)."""
    order = order_column(df, order_by)
    row = df.filter(c(column).isNotNull()).select(c(column).alias("v"), c(order).alias("o")).orderBy("o").first()
    return row["v"] if row else None


# --- columns and rows ------------------------------------------------------


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a single value, found in one aggregate job."""
    names = data_columns(df)
    counts = df.agg(*[F.count(c(n)).alias(f"f{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if counts[i] == 0]


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value, a missing value being one."""
    names = data_columns(df)
    facts = df.agg(*[f.alias(f"f{i}") for i, f in enumerate(constant_facts(df, names))]).first()
    return [n for i, n in enumerate(names) if facts[i]]


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    gone = set(names)
    return df.select(*[c(n) for n in df.columns if n == ROW or n not in gone])


def complete_row(df: DataFrame) -> Column:
    test = F.lit(True)
    for n in data_columns(df):
        test &= c(n).isNotNull()
    return test


def drop_missing_rows(df: DataFrame) -> DataFrame:
    return df.filter(complete_row(df))


# --- missing values --------------------------------------------------------


def null_counts(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.count_if(c(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)]).first() if names else ()
    return {n: row[i] for i, n in enumerate(names)}


@dataclass(frozen=True)
class Fill:
    """How one column is filled, and the type it has afterwards."""

    value: Column
    as_text: bool = False


def numeric_fills(
    df: DataFrame, names: Sequence[str], how: str, counts: dict[str, int] | None = None
) -> dict[str, Fill]:
    """Fill values for numeric columns: median, mean, zero or mode.

    ``counts`` may pass the number of values per column.
    """
    names = list(names)
    if how == "median":
        medians = exact_quantiles(df, {n: c(n) for n in names}, [0.5], counts)
        return {n: Fill(F.lit(m[0])) for n, m in medians.items() if m[0] is not None}
    if how == "mean" and names:
        means = df.agg(*[F.avg(c(n).cast("double")).alias(f"m{i}") for i, n in enumerate(names)]).first()
        return {n: Fill(F.lit(means[i])) for i, n in enumerate(names) if means[i] is not None}
    if how == "zero":
        return {n: Fill(F.lit(0).cast(dtype_of(df, n))) for n in names}
    if how == "mode":
        return mode_fills(df, names)
    return {}


def mode_fills(df: DataFrame, names: Sequence[str]) -> dict[str, Fill]:
    modes = column_modes(df, list(names)) if names else {}
    return {n: Fill(F.lit(m).cast(dtype_of(df, n))) for n, m in modes.items() if m is not None}


def categorical_fills(df: DataFrame, names: Sequence[str], how: str) -> dict[str, Fill]:
    """Fill values for text, boolean and time columns: mode, unknown or empty.

    The two literals turn a boolean or time column into text.
    """
    if how == "mode":
        return mode_fills(df, names)
    literal = {"unknown": "Unknown", "empty": ""}.get(how)
    if literal is None:
        return {}
    return {n: Fill(F.lit(literal), as_text=True) for n in names}


def apply_fills(df: DataFrame, fills: dict[str, Fill]) -> DataFrame:
    """All fills in one projection."""
    units = time_units(df, [n for n, f in fills.items() if f.as_text])
    exprs = {}
    for n, fill in fills.items():
        dtype = dtype_of(df, n)
        old = value_text(c(n), dtype, units.get(n, "micro")) if fill.as_text else c(n)
        exprs[n] = F.coalesce(old, fill.value)
    return replace_columns(df, exprs)


def fill_categorical(df: DataFrame, how: str) -> DataFrame:
    names = categorical_columns(df)
    missing = null_counts(df, names)
    return apply_fills(df, categorical_fills(df, [n for n in names if missing[n]], how))


# --- outliers and rounding -------------------------------------------------


def check_outlier_column(df: DataFrame, column: str | None) -> bool:
    """Whether outliers are handled at all; booleans have no quartiles."""
    if not column or column not in data_columns(df):
        return False
    dtype = dtype_of(df, column)
    if isinstance(dtype, T.BooleanType):
        raise TypeError("outlier bounds need a numeric column, not a boolean one")
    return isinstance(dtype, T.NumericType)


def remove_outliers(df: DataFrame, column: str, bounds: tuple[float, float]) -> DataFrame:
    """Keep rows inside the bounds; rows without a value go too."""
    return df.filter(c(column).cast("double").between(*bounds))


def cap_outliers(df: DataFrame, column: str, bounds: tuple[float, float]) -> DataFrame:
    return replace_columns(df, {column: numbers.null_safe_clip(c(column).cast("double"), *bounds)})


def round_numeric(df: DataFrame, digits: int) -> DataFrame:
    return replace_columns(
        df, {n: numbers.round_column(c(n), dtype_of(df, n), digits) for n in numeric_columns(df)}
    )

