"""Forests fitted in parts side by side.

A level of a forest is one job in which every task keeps statistics of all open nodes, so deep forests go no faster with more tasks.
Trees don't depend on each other: each part is a forest of some of the trees on few tasks, and the parts keep all cores busy.
Forests that are fitted at the same time share the threads that fit their parts, so that they leave cores to other learners.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Executor, ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.columns import c

#: Seeds of the parts differ by so much, as Spark adds the number of the partition to a seed.
_SEED_STEP = 1_000_003
#: Parts of a stored forest that are written or read side by side, each by a task or two; the driver sends the trees of so many at a time.
_STORED_AT_ONCE = 4
_KINDS = {k.__name__: k for k in (RandomForestClassificationModel, RandomForestRegressionModel)}


def part_sizes(trees: int, parts: int) -> list[int]:
    """How many trees each part has: as equal as can be, none empty."""
    parts = max(1, min(trees, parts))
    return [trees // parts + (i < trees % parts) for i in range(parts)]


class Forest:
    """A forest learner that fits its trees in ``parts``, each on ``tasks`` tasks, in the threads of ``pool``."""

    def __init__(self, learner: Callable[..., Estimator], trees: int, seed: int, parts: int, tasks: int, pool: Executor) -> None:
        self.learner, self.seed, self.tasks, self.pool = learner, seed, tasks, pool
        self.sizes = part_sizes(trees, parts)

    def fit(self, df: DataFrame) -> ForestModel:
        df = df.coalesce(self.tasks)

        def part(i: int) -> Model:
            return self.learner(numTrees=self.sizes[i], seed=self.seed + i * _SEED_STEP).fit(df)

        running = [self.pool.submit(inheritable_thread_target(df.sparkSession)(part), i) for i in range(len(self.sizes))]
        return ForestModel([x.result() for x in running])


class ForestModel(Model, MLWritable, MLReadable):
    """The trees of all parts as one forest: their mean for numbers, the sum of their votes for classes."""

    def __init__(self, models: list[Model] | None = None) -> None:
        super().__init__()
        self.parts = models or []

    @property
    def kind(self) -> str:
        """The name that Spark gives such a model."""
        return type(self.parts[0]).__name__

    @property
    def getNumTrees(self) -> int:
        return sum(m.getNumTrees for m in self.parts)

    @property
    def featureImportances(self) -> DenseVector:
        """The mean over the trees, with a sum of 1 as in Spark."""
        total = sum(m.featureImportances.toArray() * m.getNumTrees for m in self.parts)
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes = isinstance(self.parts[0], RandomForestClassificationModel)
        first = self.parts[0]
        helpers = [f"__part_{self.uid}_{i}" for i in range(len(self.parts))]
        df = dataset
        for name, model in zip(helpers, self.parts, strict=True):
            # An empty name leaves an output out.
            outputs = {model.rawPredictionCol: name, model.probabilityCol: "", model.predictionCol: ""} if classes else {model.predictionCol: name}
            df = model.transform(df, outputs)
        if not classes:
            mean = sum(c(n) * float(m.getNumTrees) for n, m in zip(helpers, self.parts, strict=True)) / float(self.getNumTrees)
            return df.withColumn(first.getPredictionCol(), mean).drop(*helpers)
        votes, add = f"__votes_{self.uid}", lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        df = df.withColumn(votes, reduce(add, [vector_to_array(c(n)) for n in helpers]))
        total = F.aggregate(c(votes), F.lit(0.0), lambda a, b: a + b)
        outputs = {
            first.getRawPredictionCol(): array_to_vector(c(votes)),
            first.getProbabilityCol(): array_to_vector(F.transform(c(votes), lambda x: x / total)),
            first.getPredictionCol(): (F.array_position(c(votes), F.array_max(c(votes))) - 1).cast("double"),  # the first of equals
        }
        return df.withColumns(outputs).drop(votes, *helpers)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, instance: ForestModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        models = self.instance.parts
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"kind": self.instance.kind, "parts": len(models)})
        with ThreadPoolExecutor(_STORED_AT_ONCE) as pool:
            save = inheritable_thread_target(self.sparkSession)(lambda i: models[i].save(f"{path}/part-{i}"))
            list(pool.map(save, range(len(models))))


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession() or self.sparkSession)
        kind = _KINDS[metadata["kind"]]
        with ThreadPoolExecutor(_STORED_AT_ONCE) as pool:
            load = inheritable_thread_target(self.sparkSession)(lambda i: kind.load(f"{path}/part-{i}"))
            found = ForestModel(list(pool.map(load, range(metadata["parts"]))))
        found._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(found, metadata)
        return found
