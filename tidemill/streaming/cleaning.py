"""The row-by-row cleaning steps on a stream.

Everything that needs a statistic of the whole table (fills, duplicates,
outliers, dropping by content) has no meaning on an endless table and is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemill.operators import cleaning as steps
from tidemill.plans.cleaning import CleanSpec
from tidemill.roles import check_supported, normalise_missing

_WHOLE_TABLE = (
    "remove_duplicates",
    "drop_empty_columns",
    "drop_constant_columns",
    "remove_outliers",
    "cap_outliers",
)


def clean_rows(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """Apply the stateless steps of a spec, in the batch order."""
    asked = [name for name in _WHOLE_TABLE if getattr(spec, name)]
    if spec.fill_missing in ("median", "mean", "mode"):
        asked.append("fill_missing")
    if spec.fill_categorical == "mode":
        asked.append("fill_categorical")
    if spec.convert_type == "date" or (spec.convert_column and spec.convert_type == "string"):
        asked.append("convert_type")
    if asked:
        raise ValueError(f"these settings need the whole table: {asked}")

    check_supported(df)
    df = normalise_missing(df)
    if spec.trim_whitespace:
        df = steps.trim_text(df)
    df = steps.blanks_to_null(df)
    renamed: dict[str, str] = {}
    if spec.normalize_headers:
        df, renamed = steps.normalise_headers(df)
    df = steps.change_case(df, spec.text_case)
    df = steps.convert_column(df, renamed.get(spec.convert_column, spec.convert_column), spec.convert_type)
    df = steps.drop_columns(df, [renamed.get(n, n) for n in spec.drop_columns])
    if spec.drop_missing_rows:
        df = steps.drop_missing_rows(df)
    fills = steps.numeric_fills(df, steps.numeric_columns(df), spec.fill_missing)
    fills |= steps.categorical_fills(df, steps.text_columns(df), spec.fill_categorical)
    df = steps.apply_fills(df, fills)
    return steps.round_numeric(df, spec.round_digits) if spec.round_numeric else df
