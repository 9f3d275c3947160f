"""Imputing, scaling and one-hot encoding as persistable Spark ML stages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.columns import c, quoted
from tidemill.learning.dictionary import TableLookup, with_positions
from tidemill.operators.counting import COUNT, SET, value_counts
from tidemill.operators.quantiles import exact_quantiles
from tidemill.roles import dtype_of, is_numeric
from tidemill.session import stage

FEATURES = "__features"
#: What the names of filled and scaled numbers begin with.
NUMBER = "__num_"
#: Distinct values of a column that are listed on the driver; wider columns are encoded by a join.
LOCAL_VALUES = 10_000


@dataclass(frozen=True)
class NumericStats:
    median: float
    mean: float
    scale: float


def numeric_stats(df: DataFrame, names: Sequence[str]) -> dict[str, NumericStats]:
    """Median, and mean and population deviation after median filling.

    Columns without any value are left out; a constant column keeps scale 1.
    """
    medians = exact_quantiles(df, {n: c(n) for n in names}, [0.5])
    kept = {n: m[0] for n, m in medians.items() if m[0] is not None}
    if not kept:
        return {}
    aggs = []
    for n, median in kept.items():
        filled = F.coalesce(c(n).cast("double"), F.lit(median))
        aggs += [F.avg(filled), F.stddev_pop(filled)]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    return {n: NumericStats(m, row[2 * i], row[2 * i + 1] or 1.0) for i, (n, m) in enumerate(kept.items())}


def impute_scale(df: DataFrame, stats: dict[str, NumericStats]) -> DataFrame:
    """Replace numeric columns by their filled and standardised values."""
    names = df.columns
    return df.select(
        *[
            ((F.coalesce(c(n).cast("double"), F.lit(s.median)) - F.lit(s.mean)) / F.lit(s.scale)).alias(n)
            if (s := stats.get(n))
            else c(n)
            for n in names
        ]
    )


def category_sql(name: str, dtype: T.DataType) -> str:
    """SQL text of a categorical column as text, the form in which it is encoded."""
    if isinstance(dtype, T.BooleanType):
        return f"CASE WHEN {quoted(name)} THEN 'True' WHEN NOT {quoted(name)} THEN 'False' END"
    return f"CAST({quoted(name)} AS STRING)"


def as_categories(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.expr(category_sql(n, dtype_of(df, n))).alias(n) for n in names])


def category_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``which`` (position of the column), ``value`` and ``n`` for every text of the columns, from one scan."""
    counts = value_counts(df, {n: c(n) for n in names})
    value = F.coalesce(*[F.col(f"v{i}") for i in range(len(names))])
    return counts.select(F.col(SET).cast("int").alias(SET), value.alias("value"), F.col(COUNT).alias("n")).where("value IS NOT NULL")


@dataclass(frozen=True)
class Preprocessor:
    """Fitted stages and, as a table, the ``name`` of each feature by its ``slot``."""

    stages: list[Transformer]
    names: DataFrame
    size: int

    @property
    def feature_names(self) -> list[str]:
        """All names, for tables that are known to have few."""
        return [r["name"] for r in self.names.orderBy("slot").collect()]


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_preprocessor(train: DataFrame, features: Sequence[str], local_values: int = LOCAL_VALUES) -> Preprocessor:
    """Fit on the train rows.

    Categories are counted into a stored table.  A column with at most ``local_values`` of them is encoded from a local
    list; a wider one, of any width, by a join with its values' positions.
    """
    spark = train.sparkSession
    numeric = [n for n in features if is_numeric(dtype_of(train, n))]
    textual = [n for n in features if n not in numeric]
    stats = numeric_stats(train, numeric)
    slots: list[str] = []
    columns = ["*"]
    for i, (n, s) in enumerate(stats.items()):
        columns.append(f"(coalesce(cast({quoted(n)} as double), {s.median!r}D) - {s.mean!r}D) / {s.scale!r}D AS {NUMBER}{i}")
        slots.append(f"{NUMBER}{i}")
    named = [(i, f"num__{n}") for i, n in enumerate(stats)]
    size, stages, wide_names = len(stats), [], None

    if textual:
        counts = stage(category_counts(as_categories(train, textual), textual), "categories")
        facts = counts.groupBy(SET).agg(F.count(F.lit(1)).alias("values"), F.min(F.struct((-F.col("n")).alias("order"), "value")).alias("mode"))
        facts = sorted(facts.collect(), key=lambda r: r[SET])  # one row for each column
        few = [r[SET] for r in facts if r["values"] <= local_values]
        lists: dict[int, list[str]] = {k: [] for k in few}
        for r in counts.where(F.col(SET).isin(few)).select(SET, "value").collect() if few else []:
            lists[r[SET]].append(r["value"])
        many = [r[SET] for r in facts if r["values"] > local_values]
        places = stage(with_positions(counts.where(F.col(SET).isin(many)), SET, "value"), "category-positions") if many else None

        starts, lookups, probe = {}, [], []
        for r in facts:
            k, name = r[SET], textual[r[SET]]
            columns.append(f"coalesce({category_sql(name, dtype_of(train, name))}, {_literal(r['mode']['value'])}) AS __cat_{k}")
            starts[k] = size
            if k in lists:
                lists[k].sort()
                named += [(size + i, f"cat__{name}_{v}") for i, v in enumerate(lists[k])]
                probe.append((f"__cat_{k}", lists[k][0]))
            else:
                table = places.where(F.col(SET) == k).select(c("value").alias("key"), c("position").cast("double").alias("value"))
                lookups.append(TableLookup(f"__cat_{k}", f"__idx_{k}", table, float(r["values"])))
                probe.append((f"__idx_{k}", float(r["values"])))
            slots.append(f"__hot_{k}")
            size += r["values"]
        # One model for each column: a shared one would pad shorter lists with nulls.
        stages += [StringIndexerModel.from_labels(lists[k], f"__cat_{k}", f"__idx_{k}", "keep") for k in few]
        indexed = [r[SET] for r in facts]
        # The place behind the last category is that of unseen values, which is the one dropped.
        encoder = OneHotEncoder(inputCols=[f"__idx_{k}" for k in indexed], outputCols=[f"__hot_{k}" for k in indexed], handleInvalid="error", dropLast=True)
        if probe:
            row = spark.createDataFrame([tuple(v for _, v in probe)], [n for n, _ in probe])
            fitted = encoder.fit(PipelineModel(stages).transform(row))
            stages += [*lookups, fitted]
        if many:
            start, label = F.lit(None).cast("long"), F.lit(None).cast("string")
            for k in many:
                start = F.when(F.col(SET) == k, F.lit(starts[k]).cast("long")).otherwise(start)
                label = F.when(F.col(SET) == k, F.concat(F.lit(f"cat__{textual[k]}_"), F.col("value"))).otherwise(label)
            wide_names = places.select((F.col("position") + start).alias("slot"), label.alias("name"))

    stages.insert(0, SQLTransformer(statement=f"SELECT {', '.join(columns)} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=slots, outputCol=FEATURES))
    names = spark.createDataFrame(named, "slot long, name string")
    return Preprocessor(stages, names if wide_names is None else names.unionByName(wide_names), size)
