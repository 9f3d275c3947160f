"""Rows of like features as one weighted row, for boosted trees.

Boosted trees read numbers by bins, and rows in the same bins and categories, a cell, take the same way down every tree.  A tree's splits and
leaves depend on the rows of a cell by their number and the sum of what is left to predict only: the squares that a cell's rows add to the
impurity are the same on both sides of every split.  So each cell is one row with the mean label and its number of rows as weight (rows of different classes stay apart), and
the hundreds of passes grow with the cells.  There are as many as rows at most, and no more than the product of the features' bins, whatever the table's size.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.feature import QuantileDiscretizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.learning.preprocessing import NUMBER, Preprocessor

BINNED, WEIGHT = "__binned", "__weight"
#: Numbers with at most so many times the bins of values stay as they are, so that none of few values is merged.
_CLEARLY = 2
#: Of the ranks at which numbers are cut.
_RANK_ERROR = 0.001


def fit_bins(train: DataFrame, prepare: Preprocessor, bins: int) -> list[Transformer]:
    """Stages behind the preprocessor's that add the features once more, with numbers of many values as bins of like size."""
    slots = prepare.stages[-1].getInputCols()
    numbers = [n for n in slots if n.startswith(NUMBER)]
    if not numbers:
        return [VectorAssembler(inputCols=slots, outputCol=BINNED)]
    rows = prepare.stages[0].transform(train).select(numbers)
    values = rows.agg(*[F.approx_count_distinct(c(n), 0.01).alias(n) for n in numbers]).first()
    wide = [n for n in numbers if values[n] > _CLEARLY * bins]
    binned = {n: f"__bin{n}" for n in wide}
    stages: list[Transformer] = []
    if wide:
        cut = QuantileDiscretizer(
            inputCols=wide, outputCols=list(binned.values()), numBucketsArray=[bins] * len(wide), relativeError=_RANK_ERROR, handleInvalid="keep"
        )
        stages.append(cut.fit(rows))
    return [*stages, VectorAssembler(inputCols=[binned.get(n, n) for n in slots], outputCol=BINNED)]


def cells(df: DataFrame, label: str, classification: bool) -> DataFrame:
    """One row for each cell, and each class in it: the binned features, the label (numbers: the mean) and the number of rows."""
    weight = F.count(F.lit(1)).cast("double").alias(WEIGHT)
    if classification:
        return df.groupBy(BINNED, label).agg(weight)
    return df.groupBy(BINNED).agg(F.avg(label).alias(label), weight)
