"""The whole exploratory profile of a table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.functions.jsonsafe import json_rows
from tidemill.functions.numbers import round_half_even
from tidemill.operators import counting, heads
from tidemill.operators import profiling as ops
from tidemill.operators.duplicates import duplicate_rows
from tidemill.operators.moments import Moments
from tidemill.roles import check_supported, data_columns, normalise_missing

DESCRIBE_METRICS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


@dataclass
class Profile:
    """Every section is a lazy DataFrame built on first use."""

    frame: DataFrame
    order_by: str | None = None
    approximate: bool = False

    @cached_property
    def _facts(self) -> tuple[int, dict[str, int], float, dict[str, Moments]]:
        """One row that the shape, missing values, size, description and correlations share."""
        return ops.facts(self.frame)

    def _local(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.frame.sparkSession.createDataFrame(rows, schema)

    @property
    def rows(self) -> int:
        return self._facts[0]

    @cached_property
    def shape(self) -> DataFrame:
        return self._local([(self.rows, len(data_columns(self.frame)))], "rows bigint, columns bigint")

    @cached_property
    def columns(self) -> DataFrame:
        return ops.column_roles(self.frame)

    @cached_property
    def missing(self) -> DataFrame:
        rows, missing, _, _ = self._facts
        share = round_half_even(F.try_divide(c("missing_values"), F.lit(rows)) * 100, 2)
        return self._local(list(missing.items()), "column string, missing_values bigint").withColumn("missing_percent", share)

    @cached_property
    def unique_counts(self) -> DataFrame:
        """At most one row per column; kept on the driver so that it can also settle duplicates."""
        counts = counting.unique_counts(self.frame, approximate=self.approximate).collect()
        counts.sort(key=lambda r: self.frame.columns.index(r["column"]))
        return self.frame.sparkSession.createDataFrame(counts, "column string, unique_count bigint")

    @cached_property
    def duplicates(self) -> DataFrame:
        """A column with as many values as rows proves there are none, without shuffling whole rows."""
        if not self.approximate and self.rows:
            most = self.unique_counts.agg(F.max("unique_count")).first()[0]
            if most == self.rows:
                return self.frame.sparkSession.createDataFrame([(0,)], "duplicate_rows bigint")
        return duplicate_rows(self.frame, self.rows)

    @cached_property
    def size(self) -> DataFrame:
        return self._local([(self._facts[2],)], "mb double").select(round_half_even(c("mb"), 3).alias("memory_usage_mb"))

    @cached_property
    def moments(self) -> dict[str, Moments]:
        return self._facts[3]

    @cached_property
    def describe(self) -> DataFrame:
        return ops.describe(self.frame, self.moments)

    @cached_property
    def correlation_pairs(self) -> DataFrame:
        return ops.correlation_pairs(self.frame, self.moments)

    @cached_property
    def correlation(self) -> DataFrame:
        return ops.correlation(self.correlation_pairs)

    @cached_property
    def strong_correlations(self) -> DataFrame:
        return ops.strong_correlations(self.correlation_pairs)

    @cached_property
    def categorical_summary(self) -> DataFrame:
        return ops.categorical_summary(self.frame)

    @cached_property
    def preview(self) -> DataFrame:
        return heads.preview(self.frame, heads.PROFILE_PREVIEW, self.order_by)

    def facts(self) -> DataFrame:
        """All numeric facts in one tidy table: ``section, item, metric, value``."""

        def tidy(df: DataFrame, section: str, item, metrics: dict) -> DataFrame:
            cells = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()]
            return df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(F.array(*cells)))

        table = F.lit("table")
        parts = [
            tidy(self.shape, "shape", table, {"rows": c("rows"), "columns": c("columns")}),
            tidy(
                self.missing,
                "missing",
                c("column"),
                {"missing_values": c("missing_values"), "missing_percent": c("missing_percent")},
            ),
            tidy(self.unique_counts, "unique", c("column"), {"unique_count": c("unique_count")}),
            tidy(self.duplicates, "duplicates", table, {"duplicate_rows": c("duplicate_rows")}),
            tidy(self.size, "size", table, {"memory_usage_mb": c("memory_usage_mb")}),
            tidy(self.describe, "describe", c("column"), {m: c(m) for m in DESCRIBE_METRICS}),
            tidy(
                self.correlation,
                "correlation",
                F.concat_ws(" vs ", "left", "right"),
                {"pearson": c("correlation")},
            ),
            tidy(
                self.categorical_summary,
                "top_values",
                F.concat_ws("=", "column", "value"),
                {"count": c("count")},
            ),
        ]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def sections(self) -> dict[str, DataFrame]:
        return {
            "shape": self.shape,
            "columns": self.columns,
            "missing": self.missing,
            "unique_counts": self.unique_counts,
            "duplicates": self.duplicates,
            "size": self.size,
            "describe": self.describe,
            "correlations": self.correlation,
            "strong_correlations": self.strong_correlations,
            "categorical_summary": self.categorical_summary,
            "preview": self.preview,
        }

    def payload(self) -> DataFrame:
        """``section, payload``: each section's rows as one JSON array (all bounded in size)."""
        result = None
        for name, df in self.sections().items():
            names = data_columns(df)
            row = json_rows(df.select(*[c(n) for n in names])).alias("row")
            part = df.select(F.monotonically_increasing_id().alias("place"), row).agg(
                F.lit(name).alias("section"),
                F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.struct("place", "row"))).getField("row"), ","), F.lit("]")).alias("payload"),
            )
            result = part if result is None else result.unionByName(part)
        return result


def profile(df: DataFrame, order_by: str | None = None, approximate: bool = False) -> Profile:
    """Profile a table; ``approximate`` trades exact distinct counts for one cheap pass."""
    check_supported(df)
    return Profile(normalise_missing(df), order_by, approximate)
