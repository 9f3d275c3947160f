"""Scores of predictions, as aggregates over (label, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.functions.numbers import round_half_even


def confusion_counts(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """``actual, predicted, n``: the only pass over the rows; the rest works on classes."""
    return df.groupBy(*[c(b) for b in by], c(label).alias("actual"), c(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """One row per actual class, one column per predicted class, empty cells 0."""
    counts = confusion_counts(df, label, prediction)
    # A class that is only ever predicted still gets its (empty) row.
    counts = counts.select(
        F.inline(
            F.array(
                F.struct("actual", "predicted", "n"),
                F.struct(F.col("predicted").alias("actual"), "predicted", F.lit(0).cast("bigint").alias("n")),
            )
        )
    )
    cells = [
        F.coalesce(F.sum(F.when(F.col("predicted") == F.lit(k), F.col("n"))), F.lit(0)).alias(str(k)) for k in classes
    ]
    return counts.groupBy("actual").agg(*cells)


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``accuracy, precision, recall, f1_score`` (weighted by class size, 0 where undefined)."""
    counts = confusion_counts(df, label, prediction)
    # Each class once as actual and once as predicted, so that all its sums meet in one group.
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("k"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("named"), hit.alias("hit")),
                F.struct(F.col("predicted").alias("k"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("named"), F.lit(0).cast("bigint").alias("hit")),
            )
        )
    )
    per_class = sides.groupBy("k").agg(F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("named")), zero)
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(F.col("hit") * 2.0, F.col("named") + F.col("support")), zero)

    def weighted(score: Column) -> Column:
        return round_half_even(F.try_divide(F.sum(score * F.col("support")), F.sum("support")), 4)

    return per_class.agg(
        round_half_even(F.try_divide(F.sum("hit"), F.sum("support")), 4).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1_score"),
    )


def accuracy(label: Column, prediction: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


def r2(label: Column, prediction: Column) -> Column:
    """1 - SSE/SST; a constant label scores 1 when met exactly and 0 otherwise."""
    error = F.sum((label - prediction) * (label - prediction))
    spread = F.var_pop(label) * F.count(label)
    return F.when(spread == 0, F.when(error == 0, 1.0).otherwise(0.0)).otherwise(F.lit(1.0) - F.try_divide(error, spread))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``r2_score, rmse, mae`` in one aggregate."""
    y, p = c(label).cast("double"), c(prediction).cast("double")
    return df.agg(
        round_half_even(r2(y, p), 4).alias("r2_score"),
        round_half_even(F.sqrt(F.avg((y - p) * (y - p))), 4).alias("rmse"),
        round_half_even(F.avg(F.abs(y - p)), 4).alias("mae"),
    )


def first_predictions(df: DataFrame, label: str, prediction: str, order: str, n: int = 10) -> DataFrame:
    """``seq, actual, predicted`` as text for the first rows."""
    top = df.select(c(order).alias("o"), c(label).alias("actual"), c(prediction).alias("predicted")).orderBy("o").limit(n)
    return top.select(
        F.row_number().over(Window.orderBy("o")).cast("int").alias("seq"),
        F.col("actual").cast("string").alias("actual"),
        F.col("predicted").cast("string").alias("predicted"),
    )
