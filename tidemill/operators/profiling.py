"""Statistics of a table, each a tidy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.columns import c
from tidemill.functions.numbers import finite_or_null, round_half_even
from tidemill.operators.counting import top_values
from tidemill.operators.moments import Moments, correlations, moments
from tidemill.operators.quantiles import exact_quantiles
from tidemill.roles import categorical_columns, data_columns, dtype_of, is_text, numeric_columns, role

# Fixed values of the report.
DESCRIBED = 8
TOP_PER_COLUMN = 10
STRONG = 0.6
STRONG_PAIRS = 10

QUARTILES = (0.25, 0.5, 0.75)
_WIDTHS = {
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.BooleanType: 1,
    T.DecimalType: 16,
}


def _stack(df: DataFrame, rows: list[list[Column]], fields: list[str]) -> DataFrame:
    """Turn the single row of an aggregate into one row per listed entry."""
    return df.select(F.inline(F.array(*[F.struct(*[v.alias(f) for v, f in zip(r, fields)]) for r in rows])))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(data_columns(df))).cast("bigint").alias("columns")
    )


def column_roles(df: DataFrame) -> DataFrame:
    """``position, column, role, dtype`` taken from the schema."""
    rows = [(i, n, role(dtype_of(df, n)), dtype_of(df, n).simpleString()) for i, n in enumerate(data_columns(df))]
    return df.sparkSession.createDataFrame(rows, "position int, column string, role string, dtype string")


def missing(df: DataFrame) -> DataFrame:
    """``column, missing_values, missing_percent`` in one aggregate pass."""
    names = data_columns(df)
    one = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)]
    )
    rows = [
        [F.lit(n), c(f"m{i}"), round_half_even(F.try_divide(c(f"m{i}"), c("n")) * 100, 2)] for i, n in enumerate(names)
    ]
    return _stack(one, rows, ["column", "missing_values", "missing_percent"])


def logical_size(df: DataFrame) -> DataFrame:
    """``memory_usage_mb``: fixed column widths plus the bytes of text values."""
    fixed = sum(_WIDTHS.get(type(dtype_of(df, n)), 8) for n in data_columns(df) if not is_text(dtype_of(df, n)))
    size = F.count(F.lit(1)) * F.lit(fixed)
    for n in data_columns(df):
        if is_text(dtype_of(df, n)):
            size = size + F.coalesce(F.sum(F.octet_length(c(n)).cast("long")), F.lit(0))
    return df.agg(round_half_even(size / F.lit(1024.0 * 1024.0), 3).alias("memory_usage_mb"))


def facts(df: DataFrame) -> tuple[int, dict[str, int], float, dict[str, Moments]]:
    """Rows, missing values by column, size and moments of a table, from one aggregate over one scan."""
    names, numeric = data_columns(df), numeric_columns(df)
    texts = [n for n in names if is_text(dtype_of(df, n))]
    fixed = sum(_WIDTHS.get(type(dtype_of(df, n)), 8) for n in names if n not in texts)
    aggs = [F.count(F.lit(1)), *[F.count(c(n)) for n in names], *[F.sum(F.octet_length(c(n)).cast("long")) for n in texts]]
    for n in numeric:
        x = c(n).cast("double")
        aggs += [F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)]
    row = list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first())
    rows, counts = row[0], dict(zip(names, row[1:]))
    size = rows * fixed + sum(x or 0 for x in row[1 + len(names) : 1 + len(names) + len(texts)])
    rest = row[1 + len(names) + len(texts) :]
    stats = {n: Moments(counts[n], *rest[4 * i : 4 * i + 4]) for i, n in enumerate(numeric)}
    return rows, {n: rows - counts[n] for n in names}, size / (1024.0 * 1024.0), stats


def describe(df: DataFrame, stats: dict[str, Moments] | None = None) -> DataFrame:
    """``column, count, mean, std, min, p25, p50, p75, max`` of every numeric column."""
    names = numeric_columns(df)
    value = {n: c(n).cast("double") for n in names}
    stats = moments(df, value) if stats is None else stats
    counts = {n: stats[n].count for n in names}
    quartiles = exact_quantiles(df, value, QUARTILES, counts)
    rows = []
    for i, n in enumerate(names):
        m = stats[n]
        rows.append((i, n, m.count, m.mean, m.std, m.low, *quartiles[n], m.high))
    measures = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    schema = "place int, column string, count bigint, " + ", ".join(f"{f} double" for f in measures)
    table = df.sparkSession.createDataFrame(rows, schema)
    return table.select("column", "count", *[round_half_even(finite_or_null(c(f)), 3).alias(f) for f in measures])


def correlation_pairs(df: DataFrame, stats: dict[str, Moments] | None = None) -> DataFrame:
    """``left, right, correlation`` for every unordered pair, the diagonal included."""
    pairs = correlations(df, numeric_columns(df), stats)
    table = df.sparkSession.createDataFrame(pairs, "left string, right string, r double")
    return table.select("left", "right", round_half_even(c("r"), 3).alias("correlation"))


def correlation(pairs: DataFrame) -> DataFrame:
    """The full symmetric matrix in long form."""
    sides = F.when(c("left") == c("right"), F.array(F.struct("left", "right"))).otherwise(
        F.array(F.struct("left", "right"), F.struct(c("right").alias("left"), c("left").alias("right")))
    )
    return pairs.select(F.explode(sides).alias("p"), "correlation").select(
        c("p").getField("left").alias("left"), c("p").getField("right").alias("right"), "correlation"
    )


def strong_correlations(pairs: DataFrame) -> DataFrame:
    """``pair, correlation``: the strongest pairs of different columns."""
    left, right = F.least("left", "right"), F.greatest("left", "right")
    return (
        pairs.filter((c("left") != c("right")) & (F.abs("correlation") >= STRONG))
        .select(F.concat_ws(" vs ", left, right).alias("pair"), "correlation")
        .orderBy(F.abs("correlation").desc(), F.asc("pair"))
        .limit(STRONG_PAIRS)
    )


def categorical_summary(df: DataFrame, columns: int = DESCRIBED, k: int = TOP_PER_COLUMN) -> DataFrame:
    """``column, value, count, rank`` for the first categorical columns."""
    names = categorical_columns(df)[:columns]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint, rank int")
    return top_values(df, names, k)
