"""Train and rank the candidate models on a table."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.functions.labels import value_text
from tidemill.learning import metrics
from tidemill.learning.dictionary import TableLookup, with_positions
from tidemill.learning.candidates import BINS, CANDIDATES, FORESTS, LABEL, Sizes, estimators, grown, importances
from tidemill.learning.cells import BINNED, cells, fit_bins
from tidemill.learning.frames import feature_columns, is_classification, model_frame, split
from tidemill.learning.preprocessing import FEATURES, fit_preprocessor
from tidemill.learning.trees import MOST_FEATURES, GrownForestModel, counted, fits, tree_features
from tidemill.roles import ROW, check_supported, dtype_of, is_numeric, normalise_missing, with_row_order
from tidemill.session import stage

TOP_FEATURES = 15
PREDICTION = "prediction"
TRAIN = "__train"
PREDICTED = "predicted_value"
#: The candidate that is fitted on cells.
BOOSTED = "xgboost"
#: Iterative learners pass over the rows hundreds of times: no more tasks than the rows are worth, or than there are cores.
_ROWS_PER_TASK = 10_000
#: Whatever the cores, no task holds more rows.
_MOST_ROWS_PER_TASK = 1_000_000
#: A forest's parts run side by side, each on a share of the tasks.
_TASK_SHARE = 4
#: Nodes of a forest that the driver may hold; trees of larger forests for numbers are grown by tasks.
_DRIVER_NODES = 1_000_000


@dataclass(frozen=True)
class TrainSpec:
    target_column: str
    feature_columns: tuple[str, ...] = ()
    model_type: str = "auto"
    train_split: float = 0.8
    key: str | None = None
    #: Categories of a column and classes that are listed on the driver; beyond it they are tables that are joined.
    local_values: int = 10_000
    local_classes: int = 1_000
    sizes: Sizes = field(default_factory=Sizes)

    def __post_init__(self) -> None:
        if not 0.5 < self.train_split < 0.95:
            raise ValueError("train_split must lie between 0.5 and 0.95")


@dataclass
class TrainResult:
    model: PipelineModel
    summary: dict[str, Any]
    leaderboard: DataFrame
    metrics: DataFrame
    confusion: DataFrame | None
    importance: DataFrame
    predictions: DataFrame
    scored: DataFrame

    def summary_frame(self) -> DataFrame:
        """The report as one row; lists and groups of values are JSON."""
        kinds = {int: "bigint", float: "double", str: "string"}
        flat = {k: v if type(v) in kinds else json.dumps(v) for k, v in self.summary.items()}
        schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in flat.items())
        return self.leaderboard.sparkSession.createDataFrame([tuple(flat.values())], schema)

    def save(self, path: str) -> None:
        """Keep one model per path, replacing an older one."""
        self.model.write().overwrite().save(path)


@dataclass(frozen=True)
class Classes:
    """The classes of a target in their natural order: a local list if there are few, else a table (``position``, ``label``)."""

    count: int
    names: list[str] | None
    table: DataFrame

    def labelled(self, df: DataFrame, text: Column) -> DataFrame:
        """Adds the numeric label of each row's class."""
        df = df.withColumn("__class", text)
        if self.names is not None:
            return StringIndexerModel.from_labels(self.names, "__class", LABEL, "error").transform(df)
        places = self.table.select(c("label").alias("key"), c("position").cast("double").alias("value"))
        nominal = {"ml_attr": {"type": "nominal", "name": LABEL, "num_vals": self.count}}
        found = TableLookup("__class", LABEL, places).transform(df)
        return found.withColumn(LABEL, c(LABEL).alias(LABEL, metadata=nominal))

    def namer(self, number: str, name: str) -> Transformer:
        """A stage that adds the class of a numeric label."""
        if self.names is not None:
            return IndexToString(inputCol=number, outputCol=name, labels=self.names)
        return TableLookup(number, name, self.table.select(c("position").cast("double").alias("key"), c("label").alias("value")))


def class_table(df: DataFrame, target: str, local_classes: int) -> Classes:
    """The classes of a target, of any number."""
    text = value_text(c(target), dtype_of(df, target)).alias("label")
    values = stage(df.select(F.lit(0).alias("g"), c(target).alias("v"), text).distinct(), "classes")
    count = values.count()
    if count <= local_classes:
        rows = sorted(values.collect(), key=lambda r: r["v"])
        names = [r["label"] for r in rows]
        return Classes(count, names, df.sparkSession.createDataFrame(list(enumerate(names)), "position long, label string"))
    return Classes(count, None, stage(with_positions(values, "g", "v").select("position", "label"), "class-positions"))


def _scores(scored: DataFrame, classification: bool) -> tuple[float, float]:
    """Train and test score of one candidate in one pass."""
    score = metrics.accuracy if classification else metrics.r2
    rows = scored.groupBy(TRAIN).agg(score(c(LABEL), c(PREDICTION)).alias("score")).collect()
    by_side = {r[TRAIN]: r["score"] for r in rows}
    return by_side.get(True, float("nan")), by_side.get(False, float("nan"))


def _tasks(rows: int, cores: int) -> tuple[int, int]:
    """How many tasks pass over the rows, and how many do so for a part of a forest.

    In each pass every task sends statistics of all open nodes, so that tasks beyond the cores only add to what is sent.
    """
    least = max(1, -(-rows // _MOST_ROWS_PER_TASK))
    every = max(least, min(cores, rows // _ROWS_PER_TASK))
    return every, max(least, every // _TASK_SHARE)


def _like(df: DataFrame, features: list[str]) -> Column:
    """What rows are sorted by within a task: like rows take the same way down a tree, so that the nodes and statistics they touch stay in the cache.

    Categories come first, as they have fewer values than numbers.
    """
    return F.struct(*[c(n) for n in sorted(features, key=lambda n: is_numeric(dtype_of(df, n)))])


def _parts(cores: int, candidates: int) -> int:
    """In how many parts a forest is fitted.

    Boosted trees are a long row of short jobs, which wait behind the forests' tasks unless these leave a core.
    """
    return cores if candidates == 1 else max(1, cores - 1)


def _large(rows: int, sizes: Sizes) -> bool:
    """Whether a forest may have more nodes than the driver may hold: a tree has at most a leaf for each row."""
    return 2 * min(rows, 2**sizes.forest_depth) * sizes.forest > _DRIVER_NODES


def train(df: DataFrame, spec: TrainSpec) -> TrainResult:
    """Fit one candidate or all of them, and keep the one with the best test score.

    Any number of categories and classes is taken; beyond ``local_values`` and ``local_classes`` they stay tables, and
    the confusion of classes has a row (``actual``, ``predicted``, ``n``) for each pair that occurs.
    """
    check_supported(df)
    df = normalise_missing(df)
    target, spark = spec.target_column, df.sparkSession
    features = feature_columns(df, target, spec.feature_columns)
    # Row positions are stored with the rows, as the split and the preview rely on them.
    frame = model_frame(df, target, features, spec.key)
    if spec.key is None:
        frame = stage(with_row_order(frame), "model-rows")
    key = spec.key or ROW

    classification = is_classification(frame, target)
    classes = class_table(frame, target, spec.local_classes) if classification else None
    if classification:
        halves = split(frame, spec.train_split, target if classes.count > 1 else None, key, flag=TRAIN)
        halves = classes.labelled(halves, value_text(c(target), dtype_of(frame, target)))
    else:
        halves = split(frame, spec.train_split, None, key, flag=TRAIN).withColumn(LABEL, c(target).cast("double"))

    # Preprocessing is fitted on train rows and its output stored once for all candidates.
    tried = [spec.model_type] if spec.model_type in CANDIDATES else list(CANDIDATES)
    prepare = fit_preprocessor(halves.filter(TRAIN), features, spec.local_values)
    forests = [n for n in tried if n in FORESTS and not classification and prepare.size <= MOST_FEATURES]
    if forests and not _large(halves.filter(TRAIN).count(), spec.sizes):
        forests = []
    bins = fit_bins(halves.filter(TRAIN), prepare, BINS) if BOOSTED in tried or forests else []
    columns = tree_features(prepare, bins) if forests else []
    ready = PipelineModel([*prepare.stages, *bins]).transform(halves)
    read = [FEATURES, *[BINNED for _ in bins[:1]], *[c(f.column) for f in columns], LABEL, TRAIN]
    ready = stage(ready.select(*read, c(key).alias("__key"), _like(frame, features).alias("__like")), "model-input")
    sizes = {r[TRAIN]: r["n"] for r in ready.groupBy(TRAIN).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_train, n_test = sizes.get(True, 0), sizes.get(False, 0)
    cores = spark.sparkContext.defaultParallelism
    tasks, forest_tasks = _tasks(n_train + n_test, cores)
    ready = ready.repartition(tasks, "__key").sortWithinPartitions("__like", "__key").drop("__like")
    ready = stage(ready, "model-parts").coalesce(tasks)

    rows = {name: ready.filter(TRAIN) for name in tried}
    if BOOSTED in tried:
        found = stage(cells(rows[BOOSTED], LABEL, classification), "cells")
        cell_tasks, _ = _tasks(found.count(), cores)
        rows[BOOSTED] = stage(found.repartition(cell_tasks), "cell-parts").coalesce(cell_tasks)
    parts = _parts(cores, len(tried))
    choices = estimators(classification, classes.count if classes else 0, n_train, spec.sizes, parts, forest_tasks)
    if forests:
        like = stage(counted(ready.filter(TRAIN), columns, LABEL), "tree-rows")
        if fits(like.count(), columns, prepare.size):
            choices |= grown(forests, columns, prepare.size, spec.sizes, parts)
            rows |= dict.fromkeys(forests, like)

    def fit(name: str) -> tuple[Model, DataFrame, tuple[float, float]]:
        found = choices[name].fit(rows[name])
        # Every pass with a model sends all its nodes to the executors: one predicts, and what follows reads the stored rows.
        predicted = stage(found.transform(ready).select(LABEL, TRAIN, "__key", PREDICTION), "predicted")
        return found, predicted, _scores(predicted, classification)

    # Candidates are independent and submit their jobs side by side.
    with ThreadPoolExecutor(len(tried)) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(fit), name) for name in tried}
        done = {name: x.result() for name, x in running.items()}
    scores = {n: s for n, (_, _, s) in done.items()}
    best = max(tried, key=lambda name: scores[name][1])  # the first of equals
    model, predicted, _ = done[best]

    test = predicted.filter(~c(TRAIN))
    last = []
    if classification:
        last = [classes.namer(PREDICTION, PREDICTED)]
        test = last[0].transform(classes.namer(LABEL, "actual").transform(test))
        scored_metrics = metrics.classification_metrics(test, "actual", PREDICTED)
        confusion = metrics.confusion_counts(test, "actual", PREDICTED)
        if classes.names is not None:
            confusion = metrics.confusion_matrix(test, "actual", PREDICTED, classes.names)
    else:
        test = test.withColumn("actual", c(LABEL)).withColumn(PREDICTED, c(PREDICTION))
        scored_metrics = metrics.regression_metrics(test, "actual", PREDICTED)
        confusion = None
    measured = scored_metrics.first().asDict()

    values = importances(model)
    top: list[tuple[str, float]] = []
    if values is not None and len(values) == prepare.size:
        by_slot = spark.createDataFrame(pa.table({"slot": pa.array(range(prepare.size), pa.int64()), "importance": [round(v, 4) for v in values]}))
        ranked = by_slot.join(prepare.names, "slot").orderBy(F.desc("importance"), "name").limit(TOP_FEATURES)
        top = [(r["name"], r["importance"]) for r in ranked.collect()]

    classes_of_report: dict[str, Any] = {}
    if classes:
        classes_of_report = {"class_count": classes.count} if classes.names is None else {"classes": sorted(classes.names)}
    numeric = [n for n in features if is_numeric(dtype_of(frame, n))]
    board = [(name, round(scores[name][0], 4), round(scores[name][1], 4)) for name in tried]
    summary = {
        "target_column": target,
        "selected_feature_columns": features,
        "requested_model_type": spec.model_type,
        "selected_model_key": best,
        "model_type": getattr(model, "kind", type(model).__name__),
        "train_split_percentage": round(spec.train_split * 100, 2),
        "train_test_ratio": f"{round(spec.train_split, 2)}:{round(1 - spec.train_split, 2)}",
        "train_rows": n_train,
        "test_rows": n_test,
        "total_rows": n_train + n_test,
        "feature_count": len(features),
        "numeric_feature_count": len(numeric),
        "categorical_feature_count": len(features) - len(numeric),
        "problem_type": "classification" if classification else "regression",
        "metrics": {**measured, **classes_of_report} if classification else measured,
        "score": measured["accuracy" if classification else "r2_score"],
        "train_score": round(scores[best][0], 4),
        "test_score": round(scores[best][1], 4),
        "top_features": top,
        "model_leaderboard": board,
    }
    return TrainResult(
        model=PipelineModel([*prepare.stages, *(bins if best == BOOSTED or isinstance(model, GrownForestModel) else []), model, *last]),
        summary=summary,
        leaderboard=spark.createDataFrame(board, "model string, train_score double, test_score double"),
        metrics=scored_metrics,
        confusion=confusion,
        importance=spark.createDataFrame(top, "name string, importance double"),
        predictions=metrics.first_predictions(test, "actual", PREDICTED, "__key"),
        scored=test,
    )
