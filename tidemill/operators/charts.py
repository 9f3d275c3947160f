"""Chart series as tidy rows: ``chart_id, type, title, seq, x, x_value, y, aggregation``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.functions.labels import float_text, time_units, value_label, value_text
from tidemill.functions.numbers import finite_or_null, to_number
from tidemill.operators.counting import countable
from tidemill.operators.heads import numbered
from tidemill.roles import (
    categorical_columns,
    check_supported,
    data_columns,
    dtype_of,
    normalise_missing,
    numeric_columns,
    order_column,
)
from tidemill.session import stage

# The chart types in default order, and how many points each shows.
CHART_TYPES = ("bar", "line", "scatter", "histogram", "box", "pie")
GROUPS = 30
POINTS = 200
SLICES = 8
#: Rows looked at in one round for the first groups.
WITNESS_ROWS = 10_000

MEAN = "mean by unique x-axis"
COUNT = "count by unique x-axis"


def first_groups(base: DataFrame, k: int = GROUPS, rows: int = WITNESS_ROWS) -> DataFrame:
    """``x, first_seen``: the first k values of ``x`` by least position ``o``; equal positions by x, rows without one last.

    Grouping a table by a column of mostly different values would shuffle it whole.  Here each round takes the first rows, a bounded top-k, that
    hold none of the values found so far, and ends with k values or no row left.  A round finds at least one
    value, mostly all of them.
    """
    order = [F.asc_nulls_last("o"), F.asc("x")]
    parts: list[DataFrame] = []
    missing = k
    while missing:
        rest = base
        for part in parts:
            rest = rest.join(F.broadcast(part.select("x")), "x", "left_anti")
        seen = rest.select("x", "o").orderBy(*order).limit(rows)
        groups = seen.groupBy("x").agg(F.min("o").alias("first_seen"), F.count(F.lit(1)).alias("n"))
        found = stage(groups.orderBy(F.asc_nulls_last("first_seen"), F.asc("x")).limit(missing), "first-groups")
        size = found.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
        parts.append(found.select("x", "first_seen"))
        missing -= size["groups"]
        if (size["rows"] or 0) < rows:
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _grouped(df: DataFrame, x: str, base: DataFrame, y) -> DataFrame:
    """First groups in order of appearance, numbered, with x as text; only their rows are aggregated."""
    first = first_groups(base)
    groups = base.join(F.broadcast(first), "x").groupBy("x").agg(y.alias("y"), F.min("first_seen").alias("first_seen"))
    unit = time_units(first, ["x"]).get("x", "micro")
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("first_seen"), F.asc("x"))).cast("int")
    return groups.withColumn("seq", place).select("seq", value_text(c("x"), dtype_of(df, x), unit).alias("x"), "y")


def mean_by_x(df: DataFrame, x: str, y: str, order_by: str | None = None) -> DataFrame:
    """``seq, x, y``: mean of y per x for the first groups to appear."""
    order = order_column(df, order_by)
    base = df.select(c(x).alias("x"), to_number(c(y), dtype_of(df, y)).alias("y"), c(order).alias("o"))
    return _grouped(df, x, base.na.drop(subset=["x", "y"]), F.avg("y"))


def count_by_x(df: DataFrame, x: str, order_by: str | None = None) -> DataFrame:
    """``seq, x, y``: rows per x for the first groups to appear."""
    order = order_column(df, order_by)
    base = df.select(c(x).alias("x"), c(order).alias("o")).na.drop(subset=["x"])
    return _grouped(df, x, base, F.count(F.lit(1)))


def pie_slices(df: DataFrame, x: str, k: int = SLICES) -> DataFrame:
    """``seq, x, y, share``: the most frequent labels and their share of the shown total."""
    counted = df.select(countable(df, [x])[x].alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("y"))
    unit = time_units(df, [x]).get(x, "micro")
    counts = counted.select(value_label(c("v"), dtype_of(df, x), unit).alias("x"), "y")
    top = counts.orderBy(F.desc("y"), F.asc("x")).limit(k)
    ranked = top.withColumn("seq", F.row_number().over(Window.orderBy(F.desc("y"), F.asc("x"))).cast("int"))
    whole = F.sum("y").over(Window.partitionBy())
    return ranked.select("seq", "x", "y", (F.col("y") * 100.0 / whole).alias("share"))


def scatter_points(df: DataFrame, x: str, y: str, order_by: str | None = None) -> DataFrame:
    """``seq, x, y``: the first points with two numbers."""
    order = order_column(df, order_by)
    points = df.select(
        to_number(c(x), dtype_of(df, x)).alias("x"), to_number(c(y), dtype_of(df, y)).alias("y"), c(order).alias("o")
    ).na.drop(subset=["x", "y"])
    return numbered(points.orderBy("o").limit(POINTS), "o").select("seq", "x", "y")


def raw_values(df: DataFrame, y: str, order_by: str | None = None) -> DataFrame:
    """``seq, x, y``: the first values of a column (what histogram and box show)."""
    order = order_column(df, order_by)
    values = df.select(c(y).cast("double").alias("y"), c(order).alias("o")).na.drop(subset=["y"])
    return numbered(values.orderBy("o").limit(POINTS), "o").select("seq", F.col("seq").cast("string").alias("x"), "y")


def chart_series(
    df: DataFrame,
    chart_types: Sequence[str] = CHART_TYPES,
    x_axis: str | None = None,
    y_axis: str | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """All requested charts.  Charts sharing a computation are computed once.

    Unknown types and charts without data are left out.
    """
    check_supported(df)
    df = normalise_missing(df)
    names, numeric, categorical = data_columns(df), numeric_columns(df), categorical_columns(df)
    x = x_axis or (categorical[0] if categorical else names[0])
    y = y_axis or (numeric[0] if numeric else None)
    places = {kind: [i for i, t in enumerate(chart_types, 1) if t == kind] for kind in CHART_TYPES}

    def rows(series: DataFrame, kinds: Sequence[str], title, aggregation: str | None = None) -> DataFrame:
        heads = [
            F.struct(F.lit(i).alias("chart_id"), F.lit(kind).alias("type"), F.lit(title(kind)).alias("title"))
            for kind in kinds
            for i in places[kind]
        ]
        numeric_x = "x" in series.columns and dict(series.dtypes)["x"] == "double"
        return series.select(
            F.inline(F.array(*heads)),
            "seq",
            (float_text(F.col("x")) if numeric_x else F.col("x")).alias("x"),
            (F.col("x") if numeric_x else F.lit(None).cast("double")).alias("x_value"),
            finite_or_null(F.col("y").cast("double")).alias("y"),
            F.lit(aggregation).cast("string").alias("aggregation"),
        )

    parts = []
    grouped = [k for k in ("line", "bar") if places[k]]
    if grouped and x in names:
        if y in names and _has_pair(df, x, y):
            parts.append(
                rows(mean_by_x(df, x, y, order_by), grouped, lambda k: f"{k.title()} of {y} by {x}", MEAN)
            )
        else:
            parts.append(rows(count_by_x(df, x, order_by), grouped, lambda k: f"{k.title()} count by {x}", COUNT))
    raw = [k for k in ("histogram", "box") if places[k]]
    source = y if y in numeric else (numeric[0] if numeric else None)
    if raw and source:
        parts.append(rows(raw_values(df, source, order_by), raw, lambda k: f"{k.title()} of {source}"))
    if places["scatter"] and x in names and y in names:
        parts.append(rows(scatter_points(df, x, y, order_by), ["scatter"], lambda k: f"Scatter of {y} by {x}"))
    slices = x if x in names else (categorical[0] if categorical else None)
    if places["pie"] and slices:
        parts.append(rows(pie_slices(df, slices), ["pie"], lambda k: f"{slices} distribution"))

    if not parts:
        return df.sparkSession.createDataFrame(
            [],
            "chart_id int, type string, title string, seq int, x string, x_value double, y double, aggregation string",
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _has_pair(df: DataFrame, x: str, y: str) -> bool:
    """Whether any row has both an x and a number in y (stops at the first)."""
    both = c(x).isNotNull() & to_number(c(y), dtype_of(df, y)).isNotNull()
    return not df.filter(both).select(F.lit(1)).isEmpty()
