"""Value counts of many columns in one scan (grouping sets).

Rows are pre-aggregated per task before the shuffle, so a value that fills a
large share of a column arrives at its reducer as one partial row per task.
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.functions.labels import NULL_LABEL, time_units, value_label
from tidemill.roles import data_columns, dtype_of, is_text

COUNT = "n"
SET = "which"
#: Columns of one grouping-sets plan; grouping_id has 64 bits.
_WIDTH = 30


def value_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``which`` (position of the column), ``v0..vk`` (its typed value), ``n``."""
    if len(values) > _WIDTH:
        parts = [value_counts(df, {n: values[n] for n in batch}) for batch in _batches(list(values))]
        for i, part in enumerate(parts):
            moved = [F.col(f"v{k}").alias(f"v{k + i * _WIDTH}") for k in range(len(part.columns) - 2)]
            parts[i] = part.select((F.col(SET) + i * _WIDTH).alias(SET), *moved, COUNT)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    keys = [f"v{i}" for i in range(len(values))]
    narrow = df.select(*[v.alias(k) for k, v in zip(keys, values.values())])
    if len(keys) == 1:
        return narrow.groupBy("v0").agg(F.count(F.lit(1)).alias(COUNT)).select(F.lit(0).alias(SET), "v0", COUNT)
    # grouping_id has one bit per column, set for the columns left out.
    full = 2 ** len(keys) - 1
    which = F.lit(None).cast("int")
    for i in range(len(keys)):
        which = F.when(F.col("gid") == F.lit(full - 2 ** (len(keys) - 1 - i)), F.lit(i)).otherwise(which)
    return (
        narrow.groupingSets([[k] for k in keys], *keys)
        .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias(COUNT))
        .select(which.alias(SET), *keys, COUNT)
    )


def _batches(names: Sequence[str], size: int = _WIDTH) -> list[list[str]]:
    """Bound the width of one grouping-sets plan on very wide tables."""
    return [list(names[i : i + size]) for i in range(0, len(names), size)]


def column_modes(df: DataFrame, names: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column as text; ties go to the smallest."""
    found: dict[str, str | None] = {}
    for batch in _batches(names):
        counts = value_counts(df, {n: c(n) for n in batch})
        keys = [f"v{i}" for i in range(len(batch))]
        best = (
            counts.filter(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
            .groupBy(SET)
            .agg(F.min(F.struct((-F.col(COUNT)).alias("order"), *keys)).alias("best"))
            .select(SET, F.coalesce(*[F.col(f"best.{k}").cast("string") for k in keys]).alias("mode"))
        )
        by_place = {r[SET]: r["mode"] for r in best.collect()}  # one row per column
        found.update({n: by_place.get(i) for i, n in enumerate(batch)})
    return found


def unique_counts(df: DataFrame, names: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """``column, unique_count``: distinct values per column, a missing value counting as one."""
    names = data_columns(df) if names is None else list(names)
    if approximate:
        one = df.agg(
            *[
                (F.approx_count_distinct(c(n)) + F.coalesce(F.max(c(n).isNull().cast("long")), F.lit(0))).alias(f"u{i}")
                for i, n in enumerate(names)
            ]
        )
        return one.select(
            F.inline(F.array(*[F.struct(F.lit(n).alias("column"), c(f"u{i}").alias("unique_count")) for i, n in enumerate(names)]))
        )
    parts = []
    for batch in _batches(names):
        labels = F.array(*[F.lit(n) for n in batch])
        parts.append(
            value_counts(df, {n: c(n) for n in batch})
            .groupBy(SET)
            .agg(F.count(F.lit(1)).alias("unique_count"))
            .select(F.element_at(labels, F.col(SET) + 1).alias("column"), "unique_count")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def countable(df: DataFrame, names: Sequence[str], null_label: str | None = None) -> dict[str, Column]:
    """Values to count per label: typed, so that text is made of distinct values only.

    A missing text shares its label with that very text and joins it here.
    """
    return {
        n: F.coalesce(c(n), F.lit(null_label or NULL_LABEL)) if is_text(dtype_of(df, n)) else c(n) for n in names
    }


def top_values(df: DataFrame, names: Sequence[str], k: int, null_label: str | None = None) -> DataFrame:
    """``column, value, count, rank``: the k most frequent labels of each column."""
    names = list(names)
    counts = value_counts(df, countable(df, names, null_label))
    units = time_units(df, names)
    value = F.lit(None).cast("string")
    for i, n in enumerate(names):
        label = value_label(c(f"v{i}"), dtype_of(df, n), units.get(n, "micro"), null_label)
        value = F.when(c(SET) == i, label).otherwise(value)
    tidy = counts.select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col(SET) + 1).alias("column"),
        value.alias("value"),
        F.col(COUNT).alias("count"),
    )
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return tidy.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def constant_facts(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Aggregates telling whether a column is constant, without a distinct."""
    return [
        (F.count(c(n)) == 0) | ((F.count(c(n)) == F.count(F.lit(1))) & (F.min(c(n)) == F.max(c(n)))) for n in names
    ]
