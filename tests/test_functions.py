"""Value expressions against Python's and pandas' own behaviour."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import dates, labels, numbers, text
from tidemill.functions.jsonsafe import iso_text, json_rows

X = F.col("x")
TEXTS = [
    "\t x  \n",
    "they're ab-cd 3rd o'NEIL",
    "",
    "  ",
    "a b",
    "\x1c\x1dq\x1f",
    "ÉTION dans, çou\nLA ligne 2x3",
    "straße ßa x1\x01 y",
    "ǆ ŉ中abc",
    None,
]


def test_strip(values):
    assert values(text.strip(X), TEXTS) == [t if t is None else t.strip() for t in TEXTS]


def test_strip_stays_linear_on_long_gaps(values):
    gap = "a" + " " * 200_000 + "b "
    assert values(F.length(text.strip(X)), [gap]) == [200_002]


def test_blank(values):
    assert values(text.blank_to_null(X), TEXTS) == [t if t and t.strip() else None for t in TEXTS]


@pytest.mark.parametrize("case", ["lower", "upper", "title"])
def test_case(values, case):
    assert values(text.text_case(X, case), TEXTS) == [t if t is None else getattr(t, case)() for t in TEXTS]


def test_unknown_case_is_ignored(values):
    assert values(text.text_case(X, "camel"), ["aB"]) == ["aB"]


NUMBERS = [" 12 ", "1e3", "+5", ".5", "5.", "-0.25", "inf", "-inf", "Infinity", "0x1F", "1d", "1_000", "1,000", "abc", "", "True", "nan", "1\t", None]


def test_to_number(values):
    expected = pd.to_numeric(pd.Series(NUMBERS, dtype=object), errors="coerce")
    found = values(numbers.to_number(X, T.StringType()), NUMBERS)
    assert found == [None if pd.isna(v) else v for v in expected]


def test_round_half_even(values):
    items = [2.675, 0.125, 0.375, 1.005, 0.285, -0.125, 1e15 + 0.3, None]
    assert values(numbers.round_half_even(X, 2), items, "double") == [
        None if v is None else float(pd.Series([v]).round(2)[0]) for v in items
    ]


def test_clip_keeps_missing(values):
    assert values(numbers.null_safe_clip(X, 0, 10), [1.0, None, 100.0, -3.0], "double") == [1.0, None, 10.0, 0.0]


FLOATS = [0.0, 1.0, -2.5, 12345678.5, 1e16, 1.5e300, 1e-5, 0.0001, 0.00012345, 123456789012345.6, 9999999.0, 1e22, float("inf"), float("-inf")]


def test_float_text(values):
    assert values(labels.float_text(X), FLOATS, "double") == [repr(v) for v in FLOATS]


def test_boolean_text(values):
    assert values(labels.value_label(X, T.BooleanType()), [True, False, None], "boolean") == ["True", "False", "nan"]


DAYS = [
    ["2024-01-02", "01/03/2024", "2024-02-30", "2024-1-5", None],
    ["01/02/2024", "13/02/2024", "12/31/2023"],
    ["13/02/2024", "01/02/2024", "02/30/2024"],
    ["2024-01-02 10:20:30", "2024-01-02", "2024-01-03 23:59:59"],
    ["2024-01-02T10:20:30.25", "2024-01-02T10:20:30.125"],
    ["20240102", "20241301"],
    ["2024/05/06", "2024/13/01"],
    ["01-02-2024 10:00", "25-12-2024 10:00"],
    ["hello", "13/02/2024", "03/04/2024", "31-12-2024"],
    ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00"],
    ["2024-01-02 03:04+00:00", "2024-02-30 03:04+00:00"],
    ["Jan 5, 2024", "Feb 30, 2024", "dec 31, 1999", "5 Jan 2024", None],
    ["January 5, 2024", "March 15, 2023"],
    ["01-Jan-2024", "31-Apr-2024", "07-AUG-2021"],
    ["5 Jan 2024", "17 Nov 2020"],
    ["2024-Jan-05", "2024-Feb-29"],
    ["1/2/24", "12/31/99", "12/31/01", "13/1/24", "31/31/24"],
    ["25/12/24", "01/02/99"],
    ["01/02/2024 03:04 PM", "01/02/2024 12:00 AM", "01/02/2024 12:30 PM", "01/02/2024 13:00 PM"],
    ["2024-01-02 11:04:05 AM", "2024-01-02 12:04:05 AM"],
    ["2024-01-02T03:04:05+02:00", "2024-07-02T23:59:59+02:00"],
    ["2024-01-02 03:04-05:30", "2024-01-02 03:04-05:30"],
    ["2024-01", "2024-13", "1999-12"],
    ["Jan 2024", "Feb 1999"],
    ["05-Jan-24", "05-Jan-95"],
]


@pytest.mark.parametrize("items", DAYS, ids=lambda d: d[0])
def test_to_timestamp(values, items):
    expected = pd.to_datetime(pd.Series(items, dtype=object), errors="coerce")
    fmt = dates.guess_format(items[0])
    found = values(dates.to_timestamp(X, T.StringType(), fmt), items)
    assert found == [None if pd.isna(v) else v.to_pydatetime().replace(tzinfo=None) for v in expected]


def test_offsets_are_given_in_that_of_the_first_value(values):
    items = ["2024-01-02 03:04:05+02:00", "2024-01-02 03:04:05Z", "2024-01-02 03:04:05-0130"]
    found = values(dates.to_timestamp(X, T.StringType(), dates.guess_format(items[0])), items)
    assert [str(v) for v in found] == ["2024-01-02 03:04:05", "2024-01-02 05:04:05", "2024-01-02 06:34:05"]


def test_numbers_are_nanoseconds(values):
    items = [0, 20240102, 1704186000123456789, -1_000_000, None]
    expected = pd.to_datetime(pd.Series(items, dtype="Int64"), errors="coerce")
    found = values(dates.to_timestamp(X, T.LongType()), items, "bigint")
    assert found == [None if pd.isna(v) else v.floor("us").to_pydatetime() for v in expected]


def test_time_as_number(values):
    at = [datetime(2024, 1, 2, 3, 4, 5, 250000), datetime(1969, 12, 31, 23, 0)]
    found = values(numbers.to_number(X, T.TimestampNTZType()), at, "timestamp_ntz")
    assert found == [float(pd.Timestamp(a).value) for a in at]


@pytest.mark.parametrize(
    "items",
    [
        [datetime(2024, 1, 2), datetime(2024, 1, 3)],
        [datetime(2024, 1, 2), datetime(2024, 1, 3, 4)],
        [datetime(2024, 1, 2, 0, 0, 0, 250000), datetime(2024, 1, 3)],
        [datetime(2024, 1, 2, 0, 0, 0, 250001), datetime(2024, 1, 3)],
    ],
)
def test_time_labels_follow_the_finest_unit(spark, items):
    df = spark.createDataFrame([(i,) for i in items], "x timestamp_ntz")
    found = df.select(labels.label_columns(df, ["x"])["x"].alias("y")).collect()
    assert sorted(r["y"] for r in found) == sorted(pd.Series(items).astype(str))


def test_iso_text(values):
    at = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 250000), None]
    assert values(iso_text(X), at, "timestamp_ntz") == [a and a.isoformat() for a in at]


def test_json_rows(spark):
    df = spark.createDataFrame(
        [(1, float("inf"), [1.0, float("nan")], {"k": float("-inf")}, (float("nan"), "a"), datetime(2024, 1, 2))],
        "a int, b double, c array<double>, d map<string, double>, e struct<f: double, g: string>, h timestamp_ntz",
    )
    found = df.select(json_rows(df).alias("j")).first()["j"]
    assert found == '{"a":1,"b":null,"c":[1.0,null],"d":{"k":null},"e":{"f":null,"g":"a"},"h":"2024-01-02T00:00:00"}'
