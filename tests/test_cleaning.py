from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill import CleanSpec, chart_series, clean, profile
from tidemill.columns import c
from tidemill.operators import cleaning as steps
from tidemill.operators import duplicates
from tidemill.operators.counting import column_modes, top_values, unique_counts
from tidemill.roles import ROW, check_supported, with_row_order

NOTHING = CleanSpec(fill_missing="none", fill_categorical="none", remove_duplicates=False)


def only(**changes):
    return CleanSpec(**{"fill_missing": "none", "fill_categorical": "none", "remove_duplicates": False, **changes})


def rows(df, *names):
    names = names or [n for n in df.columns if n != ROW]
    if ROW in df.columns:
        df = df.orderBy(ROW)
    return [tuple(r) for r in df.select(*[c(n) for n in names]).collect()]


@pytest.fixture
def people(spark):
    data = [
        (0, "Alice ", 10.0, 100, True),
        (1, "Bob", None, 150, None),
        (2, "  ", 9999.0, 120, False),
        (3, "Bob", None, 150, None),
    ]
    return spark.createDataFrame(data, f"{ROW} bigint, name string, value double, score bigint, ok boolean")


def test_defaults_fill_and_deduplicate(people):
    result = clean(people)
    assert rows(result.frame) == [
        ("Alice ", 10.0, 100, True),
        ("Bob", 5004.5, 150, False),
        ("Alice ", 9999.0, 120, False),
    ]
    s = result.summary
    assert (s["rows_before"], s["rows_after"], s["duplicates_removed"], s["missing_after"]) == (4, 3, 1, 0)
    assert s["columns_after"] == ["name", "value", "score", "ok"]


def test_blank_text_is_missing_even_without_trim(people):
    assert rows(clean(people, NOTHING).frame, "name")[2] == (None,)


def test_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(5, "a"), (2, "b"), (1, "a"), (9, "b"), (7, None), (8, None)], f"{ROW} bigint, x string")
    for small_rows in (100, 0):
        kept = duplicates.drop_duplicates(df, "copies", 6, small_rows).orderBy(ROW)
        assert [tuple(r) for r in kept.select(ROW, "x", "copies").collect()] == [(1, "a", 2), (2, "b", 2), (7, None, 2)]


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_duplicates_by_hash(spark, monkeypatch, limit):
    """Rows that are mostly one value, with and without room to broadcast the repeated hashes."""
    monkeypatch.setattr(duplicates, "MAX_REPEATED", limit)
    df = spark.range(3000).selectExpr(
        f"id AS {ROW}",
        "CASE WHEN id % 3 = 0 THEN 0.0 WHEN id % 3 = 1 THEN -0.0 ELSE id * 1.0D END AS x",
        "CASE WHEN id < 2000 THEN NULL ELSE 'a' END AS s",
        "CASE WHEN id < 2000 THEN 'a' END AS t",
    )
    direct = {tuple(r) for r in duplicates.drop_duplicates(df, "copies").collect()}
    hashed = {tuple(r) for r in duplicates.drop_duplicates(df, "copies", 3000, 0).collect()}
    assert direct == hashed and len(direct) == 1002
    assert sum(r[-1] for r in hashed) == 3000
    assert duplicates.duplicate_rows(df, 3000, 0).first()[0] == 1998


@pytest.mark.parametrize("filter_bytes", [64 << 20, 1])
def test_filter_of_repeated_hashes(spark, filter_bytes):
    """One row in ten is a copy: only those and a few others are grouped; a filter that is too small finds the same."""
    df = spark.range(40_000).selectExpr(f"id AS {ROW}", "CASE WHEN id % 10 = 9 THEN id - 1 ELSE id END AS x", "'p' AS _hash", "id % 1 AS _bits")
    names = ["x", "_hash", "_bits"]
    by_filter = duplicates.Repeated(df, names, 0, filter_bytes)
    assert by_filter.table.agg(F.sum(F.size("_bits"))).first()[0] * 8 <= max(filter_bytes, 4096)
    passed = by_filter.rows(df, shared=True).count()
    assert passed + by_filter.rows(df, shared=False).count() == 40_000
    assert 8_000 <= passed < (10_000 if filter_bytes > 1 else 40_001)
    kept = duplicates.drop_duplicates(df, "copies", 40_000, 0, 0, filter_bytes)
    assert kept.columns == [*df.columns, "copies"]
    want = {(i, i, "p", 0, 1 + (i % 10 == 8)) for i in range(40_000) if i % 10 != 9}
    assert {tuple(r) for r in kept.collect()} == want
    assert duplicates.duplicate_rows(df, 40_000, 0, 0, filter_bytes).first()[0] == 4_000


def test_rows_without_equals_are_not_shuffled(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 10 = 9 THEN id - 1 ELSE id END AS x")
    unique = duplicates.Repeated(df, ["x"], 0, 1 << 20).rows(df, shared=False)
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_colliding_hashes_are_compared(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "row_hash", lambda df, names: c(names[0]) % 2)
    df = spark.range(20).selectExpr(f"id AS {ROW}", "id % 10 AS x")
    kept = duplicates.drop_duplicates(df, "copies", 20, 0).collect()
    assert {(r["x"], r[ROW], r["copies"]) for r in kept} == {(i, i, 2) for i in range(10)}
    assert duplicates.duplicate_rows(df, 20, 0).first()[0] == 10


def test_duplicates_differ_after_trim(spark):
    df = spark.createDataFrame([(0, "a"), (1, " a")], f"{ROW} bigint, x string")
    assert clean(df, only(remove_duplicates=True)).summary["duplicates_removed"] == 0
    assert clean(df, only(remove_duplicates=True, trim_whitespace=True)).summary["duplicates_removed"] == 1


def test_headers():
    assert steps.normalised_headers([" A b", "A_b", "!!", "a b", "É-1"]) == ["a_b", "a_b_2", "column", "a_b_3", "é1"]
    assert steps.normalised_headers(["a", "a_2", "a"]) == ["a", "a_2", "a_3"]


def test_headers_carry_the_other_settings(spark):
    df = spark.createDataFrame([(0, "1", 5.0, "x"), (1, "2", 6.0, "y")], f"{ROW} bigint, `My Col` string, `Out.1` double, `Go ne` string")
    spec = only(
        normalize_headers=True,
        drop_columns=("Go ne",),
        convert_column="My Col",
        convert_type="number",
        outlier_column="Out.1",
        target_column="My Col",
    )
    result = clean(df, spec)
    assert result.frame.columns == [ROW, "my_col", "out1"]
    assert result.summary["dropped_columns"] == ["go_ne"]
    assert result.summary["outlier_column"] == "out1"
    assert result.summary["conversion"] == {"column": "my_col", "target_type": "number", "converted_cells": 2}
    assert result.target_column == "my_col"
    assert result.summary["header_map"] == {"My Col": "my_col", "Out.1": "out1", "Go ne": "go_ne"}


@pytest.mark.parametrize(
    "to, values, cells",
    [("number", [1.0, None, None], 1), ("string", ["1", "x", None], 3), ("other", ["1", "x", None], 0)],
)
def test_conversion_counts(spark, to, values, cells):
    df = spark.createDataFrame([(0, "1"), (1, "x"), (2, None)], f"{ROW} bigint, x string")
    result = clean(df, only(convert_column="x", convert_type=to))
    assert [v for (v,) in rows(result.frame)] == values
    assert result.summary["conversion"]["converted_cells"] == cells


def test_date_conversion_follows_the_first_value(spark):
    df = spark.createDataFrame([(2, "13/02/2024"), (0, None), (1, "01/02/2024")], f"{ROW} bigint, x string")
    result = clean(df, only(convert_column="x", convert_type="date"))
    assert rows(result.frame) == [(None,), (datetime(2024, 1, 2),), (None,)]
    assert result.summary["conversion"]["converted_cells"] == 1


def test_absent_columns_are_ignored(people):
    spec = only(drop_columns=("nope",), outlier_column="nope", remove_outliers=True, convert_column="nope", convert_type="number")
    s = clean(people, spec).summary
    assert s["dropped_columns"] == [] and s["conversion"] is None and s["outliers_removed"] == 0


def test_empty_and_constant_columns(spark):
    df = spark.createDataFrame(
        [(0, None, 1, 5, " ", None), (1, None, 1, None, "", None)],
        f"{ROW} bigint, none double, one int, gap int, blank string, text string",
    )
    s = clean(df, only(drop_empty_columns=True, drop_constant_columns=True)).summary
    assert s["empty_columns_dropped"] == ["none", "blank", "text"]
    assert s["constant_columns_dropped"] == ["one"]
    assert s["columns_after"] == ["gap"]
    assert clean(df, only(drop_constant_columns=True)).summary["columns_after"] == ["gap"]
    assert clean(df.limit(0), only(drop_empty_columns=True)).summary["columns_after"] == []


def test_missing_rows(people):
    s = clean(people, only(drop_missing_rows=True, remove_duplicates=True)).summary
    assert (s["rows_after"], s["missing_rows_dropped"], s["duplicates_removed"]) == (1, 3, 0)
    s = clean(people, only(drop_missing_rows=True)).summary
    assert (s["rows_after"], s["missing_rows_dropped"]) == (1, 3)


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame(
        [(3, "b", 1.5, True), (1, "a", 2.5, None), (3, None, 2.5, None), (1, "a", 1.5, False), (2, "b", None, True), (None, None, None, False)],
        "n int, s string, d double, b boolean",
    )
    assert column_modes(df, ["n", "s", "d", "b"]) == {"n": "1", "s": "a", "d": "1.5", "b": "false"}
    assert column_modes(df.select("s"), ["s"]) == {"s": "a"}
    empty = spark.createDataFrame([(None, None)], "n int, s string")
    assert column_modes(empty, ["n", "s"]) == {"n": None, "s": None}


def test_modes_of_many_columns(spark):
    wide = spark.range(20).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(37)])
    assert column_modes(wide, wide.columns) == dict.fromkeys(wide.columns, "0")
    counts = {r["column"]: r["unique_count"] for r in unique_counts(wide).collect()}
    assert counts == {f"c{i}": min(20, i + 2) for i in range(37)}


def test_all_missing_stays(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2)], "x double, s string, k int")
    result = clean(df, CleanSpec(remove_duplicates=False))
    assert result.summary["missing_after"] == 4


@pytest.mark.parametrize("how, text", [("unknown", "Unknown"), ("empty", "")])
def test_literal_fills_turn_to_text(spark, how, text):
    df = spark.createDataFrame(
        [(0, True, datetime(2024, 1, 2), "a"), (1, None, None, None)], f"{ROW} bigint, b boolean, t timestamp_ntz, s string"
    )
    assert rows(clean(df, only(fill_categorical=how)).frame) == [("True", "2024-01-02", "a"), (text, text, text)]


def test_outliers(spark):
    data = [(i, float(v) if v is not None else None) for i, v in enumerate([1, 2, 3, 4, 5, None, 100])]
    df = spark.createDataFrame(data, f"{ROW} bigint, x double")
    removed = clean(df, only(remove_outliers=True, cap_outliers=True, outlier_column="x"))
    assert rows(removed.frame) == [(1.0,), (2.0,), (3.0,), (4.0,), (5.0,)]
    assert removed.summary["outliers_removed"] == 2 and removed.summary["outliers_capped"] == 0
    capped = clean(df, only(cap_outliers=True, outlier_column="x"))
    assert rows(capped.frame)[-2:] == [(None,), (8.5,)]
    assert capped.summary["outliers_capped"] == 2


def test_boolean_outliers_are_refused(people):
    with pytest.raises(TypeError):
        clean(people, only(remove_outliers=True, outlier_column="ok"))


def test_rounding(spark):
    df = spark.createDataFrame([(0, 2.675, 7)], f"{ROW} bigint, x double, n int")
    assert rows(clean(df, only(round_numeric=True)).frame) == [(2.68, 7)]
    with pytest.raises(ValueError):
        CleanSpec(round_digits=9)


def test_cleaning_twice_changes_nothing(people):
    spec = CleanSpec(trim_whitespace=True, text_case="title", normalize_headers=True, round_numeric=True)
    once = clean(people, spec)
    twice = clean(once.frame, spec)
    assert rows(once.frame) == rows(twice.frame)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 3.0)], f"{ROW} bigint, x double")
    assert rows(clean(df, only(fill_missing="mean")).frame) == [(3.0,), (3.0,)]


def test_nested_columns_are_refused(spark):
    with pytest.raises(TypeError):
        check_supported(spark.createDataFrame([([1.0],)], "v array<double>"))


def test_row_order_is_kept_once_given(spark):
    df = with_row_order(spark.range(5))
    assert with_row_order(df).columns == df.columns


def test_matches_pandas_end_to_end(spark):
    pdf = pd.DataFrame(
        {
            "a": [1.0, None, 3.0, 3.0, 250.0, 1.0, 4.0],
            "s": [" x", "y ", None, "x", "", " x", "z"],
            "n": [1, 2, 3, 3, 5, 1, 4],
        }
    )
    df = spark.createDataFrame([(i, *(None if pd.isna(v) else v for v in r)) for i, r in enumerate(pdf.itertuples(index=False))], f"{ROW} bigint, a double, s string, n bigint")
    result = clean(df, CleanSpec(trim_whitespace=True, text_case="upper", cap_outliers=True, outlier_column="a", round_numeric=True, round_digits=1))

    want = pdf.copy()
    want["s"] = want["s"].str.strip().replace("", None).str.upper()
    want = want.drop_duplicates()
    want["a"] = want["a"].fillna(want["a"].median())
    want["s"] = want["s"].fillna(want["s"].mode().iloc[0])
    q1, q3 = want["a"].quantile([0.25, 0.75])
    want["a"] = want["a"].clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)).round(1)
    assert rows(result.frame) == [tuple(r) for r in want.itertuples(index=False)]


def test_any_column_name_is_safe(spark):
    """Names used inside the library may also be names of data."""
    names = ["n", "k", "v0", "which", "count", "value", "x", "y", "o", "label", "a.b", "it`s", "rows", "place"]
    df = spark.createDataFrame(
        [(i, *[None if (i + j) % 5 == 0 else float(i * (j + 1) % 41) for j in range(len(names))]) for i in range(40)],
        ", ".join([f"{ROW} bigint", *[f"`{n.replace('`', '``')}` double" for n in names]]),
    )
    spec = CleanSpec(fill_missing="mode", cap_outliers=True, outlier_column="a.b", round_numeric=True)
    result = clean(df, spec)
    assert result.summary["missing_after"] == 0 and result.frame.count() == 40
    assert clean(df, CleanSpec()).frame.count() == 40
    p = profile(df)
    assert p.facts().count() > 0 and p.payload().count() == 11 and p.duplicates.first()[0] == 0
    assert chart_series(df.withColumn("type", c("n").cast("string"))).count() > 0
    assert top_values(df, names, 3).count() > len(names)
