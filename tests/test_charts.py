from datetime import datetime

import pandas as pd
import pytest

from tidemill import chart_series
from tidemill.operators import charts
from tidemill.roles import ROW


@pytest.fixture(scope="module")
def sales(spark):
    data = [
        (i, ["pear", "fig", None, "apple"][i % 4], str(i) if i % 5 else "n/a", float(i % 7) if i % 3 else None)
        for i in range(300)
    ]
    return spark.createDataFrame(data, f"{ROW} bigint, fruit string, digits string, price double")


def series(df, *names):
    return [tuple(r) for r in df.orderBy("seq").select(*names).collect()]


def test_all_types(sales):
    charts_ = chart_series(sales)
    titles = {(r["chart_id"], r["type"], r["title"], r["aggregation"]) for r in charts_.collect()}
    assert titles == {
        (1, "bar", "Bar of price by fruit", charts.MEAN),
        (2, "line", "Line of price by fruit", charts.MEAN),
        (4, "histogram", "Histogram of price", None),
        (5, "box", "Box of price", None),
        (6, "pie", "fruit distribution", None),
    }
    bars = [tuple(r) for r in charts_.filter("type = 'bar'").orderBy("seq").select("x", "y").collect()]
    lines = [tuple(r) for r in charts_.filter("type = 'line'").orderBy("seq").select("x", "y").collect()]
    assert bars == lines and [x for x, _ in bars] == ["fig", "pear", "apple"]


def test_groups_come_in_order_of_appearance(sales):
    pdf = sales.toPandas()
    want = pdf.dropna(subset=["fruit", "price"]).groupby("fruit", sort=False)["price"].mean()
    found = series(charts.mean_by_x(sales, "fruit", "price"), "x", "y")
    assert [x for x, _ in found] == want.index.tolist()
    assert [y for _, y in found] == pytest.approx(want.tolist())


def test_only_thirty_groups(spark):
    df = spark.range(100).selectExpr(f"id AS {ROW}", "99 - id AS x", "id AS y")
    found = series(charts.count_by_x(df, "x"), "x", "y")
    assert len(found) == 30 and found[0] == ("99", 1)


def test_falls_back_to_counts(spark):
    df = spark.createDataFrame([(0, "a", "q"), (1, "b", "w"), (2, "a", None)], f"{ROW} bigint, x string, y string")
    found = chart_series(df, ["line"], "x", "y").orderBy("seq").collect()
    assert [(r["title"], r["x"], r["y"], r["aggregation"]) for r in found] == [
        ("Line count by x", "a", 2.0, charts.COUNT),
        ("Line count by x", "b", 1.0, charts.COUNT),
    ]


def test_scatter_coerces_both_axes(sales):
    found = chart_series(sales, ["scatter"], "digits", "price").orderBy("seq").collect()
    pdf = sales.toPandas()
    want = pdf.assign(digits=pd.to_numeric(pdf["digits"], errors="coerce")).dropna(subset=["digits", "price"]).head(200)
    assert [r["x_value"] for r in found] == want["digits"].tolist()
    assert [r["y"] for r in found] == want["price"].tolist()
    assert found[0]["x"] == "1.0"


def test_same_column_on_both_axes(spark):
    df = spark.createDataFrame([(0, 1.5), (1, 2.5), (2, 1.5)], f"{ROW} bigint, v double")
    found = chart_series(df, ["bar", "scatter"]).orderBy("type", "seq").collect()
    assert [(r["type"], r["x"], r["y"]) for r in found] == [
        ("bar", "1.5", 1.5),
        ("bar", "2.5", 2.5),
        ("scatter", "1.5", 1.5),
        ("scatter", "2.5", 2.5),
        ("scatter", "1.5", 1.5),
    ]


def test_pie_counts_missing_and_text_nan_together(spark):
    df = spark.createDataFrame([("a",), ("nan",), (None,), ("b",), ("b",), ("b",)], "x string")
    assert series(charts.pie_slices(df, "x"), "x", "y", "share") == [
        ("b", 3, 50.0),
        ("nan", 2, pytest.approx(100 / 3)),
        ("a", 1, pytest.approx(50 / 3)),
    ]


def test_raw_values(sales):
    found = series(charts.raw_values(sales, "price"), "seq", "x", "y")
    assert len(found) == 200 and found[0] == (1, "1", 1.0) and found[-1][1] == "200"


def test_unknown_types_and_missing_axes(sales):
    assert chart_series(sales, ["radar"]).count() == 0
    assert chart_series(sales, ["bar", "scatter"], "nope", "price").count() == 0
    pie = chart_series(sales, ["pie"], "nope")
    assert pie.first()["title"] == "fruit distribution"


def test_repeated_type_makes_two_charts(sales):
    assert chart_series(sales, ["pie", "pie"]).select("chart_id").distinct().count() == 2


def test_time_axis(spark):
    df = spark.createDataFrame([(0, datetime(2024, 1, 2), 1.0), (1, datetime(2024, 1, 1), 2.0)], f"{ROW} bigint, t timestamp_ntz, y double")
    found = chart_series(df, ["line", "scatter"]).orderBy("type", "seq").collect()
    assert [r["x"] for r in found[:2]] == ["2024-01-02", "2024-01-01"]
    assert found[2]["x_value"] == float(pd.Timestamp("2024-01-02").value)


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_first_groups_in_rounds(spark, rows):
    """A hot value, unique values after it, rows without position and without x."""
    data = [(k if k < 95 else None, "hot" if k < 40 or k % 3 == 0 else None if k % 7 == 0 else f"v{k:03d}") for k in range(100)]
    df = spark.createDataFrame(data, "o long, x string").repartition(5)
    want: dict = {}
    for o, x in sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        if x is not None:
            want.setdefault(x, o)
    found = [tuple(r) for r in charts.first_groups(df.na.drop(subset=["x"]), 30, rows).collect()]
    assert found == list(want.items())[:30]
    counted = series(charts.count_by_x(df, "x", "o"), "x", "y")
    assert counted == [(x, sum(v == x for _, v in data)) for x in list(want)[:30]]


def test_unique_groups_are_not_shuffled_whole(spark):
    df = spark.range(50_000).selectExpr(f"id AS {ROW}", "concat('k', id) AS x", "id * 1.0 AS y")
    assert charts.mean_by_x(df, "x", "y").count() == 30
    plan = charts.mean_by_x(df, "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_no_rows_give_no_groups(spark):
    df = spark.createDataFrame([], f"{ROW} long, x string, y double")
    assert charts.count_by_x(df, "x").count() == charts.mean_by_x(df, "x", "y").count() == 0
