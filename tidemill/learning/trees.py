"""Forests for numbers whose trees are grown whole, each by one task.

Spark's learner keeps all nodes of all trees on the driver and runs several jobs for each level.  A forest that grows until its leaves are pure has
about twice as many nodes as there are cells of like rows, times the trees, which is more than a driver holds.  Here a tree is one task's work: the rows are sent to the
tasks as counted cells of like features and label, packed, and trees are stored as packed nodes in a table.  The driver never holds more than a part of either.

A tree is the one that Spark grows: rows are drawn for each tree (counted rows by the distributions of the sums: Poisson for draws with
replacement, binomial for draws without), a number is cut between its bins, a category is told from all others, and the split that
lowers the squared error most wins, as long as it lowers it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from threading import Lock

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Model
from pyspark.ml.feature import OneHotEncoderModel
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.learning.preprocessing import NUMBER, Preprocessor
from tidemill.session import stage

#: Rows of like features and label in the table that tasks grow trees on.
COUNT = "__n"
#: Of a forest's features (each category is one), and bytes of all packed rows, beyond which no task holds them: Spark's learner passes over them then.
MOST_FEATURES = 1_000
_MOST_BYTES = 100_000_000
#: Bytes of packed rows or trees that the driver holds at once, and sends as one variable.
_SENT_BYTES = 16_000_000
#: Cells whose predictions a task keeps.
_KEPT_CELLS = 1_000_000
_TREES = "tree int, slots binary, cuts binary, links binary, leaves binary, gains array<double>"


@dataclass
class Feature:
    """A column of numbers, or of positions of categories: its first slot among the features and, for categories, how many there are."""

    column: str
    slot: int
    width: int
    #: Where a number's bins end.
    cuts: list[float]

    @property
    def codes(self) -> int:
        return (self.width or len(self.cuts)) + 1

    def coded(self, values: np.ndarray) -> np.ndarray:
        return (values if self.width else np.searchsorted(self.cuts, values, "left")).astype(np.uint16)


def tree_features(prepare: Preprocessor, bins: list) -> list[Feature]:
    """The columns behind the slots of the features; numbers of many values are read by their bins."""
    slots = prepare.stages[-1].getInputCols()
    read = dict(zip(slots, bins[-1].getInputCols() if bins else slots, strict=True))
    found, slot = [], 0
    encoders = [x for x in prepare.stages if isinstance(x, OneHotEncoderModel)]
    hot = {out: (name, size - 1) for x in encoders for name, out, size in zip(x.getInputCols(), x.getOutputCols(), x.categorySizes, strict=True)}
    for name in slots:
        if name.startswith(NUMBER):
            found.append(Feature(read[name], slot, 0, []))
            slot += 1
        else:
            column, width = hot[name]
            found.append(Feature(column, slot, width, []))
            slot += width
    return found


def counted(rows: DataFrame, features: list[Feature], label: str) -> DataFrame:
    """One row for all rows of like features and label, with their number."""
    return rows.groupBy(*[c(f.column) for f in features], c(label)).agg(F.count(F.lit(1)).alias(COUNT))


def fits(rows: int, features: list[Feature], size: int) -> bool:
    """Whether a task can hold so many counted rows."""
    return size <= MOST_FEATURES and rows * (2 * len(features) + 16) <= _MOST_BYTES


def cut_points(values: list[float], counts: list[int], bins: int) -> list[float]:
    """Where numbers are cut into at most ``bins`` bins of like size: between neighbours, if there are so few."""
    order = np.argsort(values)
    values, counts = np.asarray(values)[order], np.asarray(counts, float)[order]
    group = np.arange(len(values))
    if len(values) > bins:
        group = ((np.cumsum(counts) - counts / 2) / counts.sum() * bins).astype(int)
    ends = np.flatnonzero(np.diff(group))
    return ((values[ends] + values[ends + 1]) / 2).tolist()


def grow(
    features: list[Feature], codes: list[np.ndarray], weight: np.ndarray, total: np.ndarray, depth: int, least: float, chosen: int, size: int, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree on cells with the weight and the sum of labels of their rows: slots (-1: a leaf), cuts, links, leaves, and the gain of each slot.

    The link of a leaf is its place among the leaves, that of another node its left child, which the right one follows.  A level is
    a few sorts of the cells in open nodes; ``chosen`` slots are drawn for each node.
    """
    codes, node, mean = [x.astype(np.int64) for x in codes], np.zeros(len(weight), np.int64), total / weight
    slots, cuts, links, leaves, gains = [], [], [], [], np.zeros(size)
    n, first, done = 1, 0, 0
    same = 1e-12 * np.abs(mean).max(initial=0)
    owner = np.repeat(np.arange(len(features)), [f.width or 1 for f in features])
    starts_at, is_number = np.array([f.slot for f in features]), np.array([not f.width for f in features])
    while n:
        w, s = np.bincount(node, weight, n), np.bincount(node, total, n)
        base, best, best_slot, best_cut = s * s / w, np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
        keys = None
        if chosen < size:
            keys = rng.random((n, size))
            keys = keys <= np.partition(keys, chosen - 1, axis=1)[:, chosen - 1 : chosen]
        for f, code in zip(features if depth else [], codes):
            key = node * f.codes + code
            order = np.argsort(key, kind="stable")
            key = key[order]
            runs = np.flatnonzero(np.diff(key, prepend=-1))
            of, value = np.divmod(key[runs], f.codes)
            rw, rs = np.add.reduceat(weight[order], runs), np.add.reduceat(total[order], runs)
            begin = np.searchsorted(of, np.arange(n))
            slot = f.slot + value if f.width else np.full(len(of), f.slot)
            valid = (value < f.width) if f.width else np.append(of[1:] == of[:-1], False)
            if not f.width:  # all up to this value
                cw, cs = np.cumsum(rw), np.cumsum(rs)
                rw, rs = cw - (cw[begin] - rw[begin])[of], cs - (cs[begin] - rs[begin])[of]
            ow, os = w[of] - rw, s[of] - rs
            valid &= (rw >= least) & (ow >= least)
            if keys is not None:
                valid &= keys[of, np.minimum(slot, size - 1)]
            gain = np.zeros(len(of))
            gain[valid] = rs[valid] ** 2 / rw[valid] + os[valid] ** 2 / ow[valid] - base[of[valid]]
            most = np.maximum.reduceat(gain, begin)
            at = np.flatnonzero(gain == most[of])
            at = at[np.unique(of[at], return_index=True)[1]]  # the first of equals
            better = most > best
            best[better], best_slot[better], best_cut[better] = most[better], slot[at[better]], value[at[better]]
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(low, node, mean)
        np.maximum.at(high, node, mean)
        split = (best > 0) & (high - low > same)
        gains += np.bincount(best_slot[split], best[split], size)
        rank, opened = np.cumsum(split) - 1, int(split.sum())
        slots.append(np.where(split, best_slot, -1).astype(np.int16))
        cuts.append(np.where(split, best_cut, 0).astype(np.uint16))
        links.append(np.where(split, first + n + 2 * rank, done + np.cumsum(~split) - 1).astype(np.int32))
        leaves.append((s / w)[~split])
        first, done, depth = first + n, done + n - opened, depth - 1
        stay = split[node]
        node, weight, total, mean, codes = node[stay], weight[stay], total[stay], mean[stay], [x[stay] for x in codes]
        own = owner[best_slot[node]]
        right = np.zeros(len(node), np.int64)
        for i, code in enumerate(codes):
            of = own == i
            right[of] = code[of] > best_cut[node[of]] if is_number[i] else code[of] == best_slot[node[of]] - starts_at[i]
        node, n = 2 * rank[node] + right, 2 * opened
    return np.concatenate(slots), np.concatenate(cuts), np.concatenate(links), np.concatenate(leaves), gains


def walk(features: list[Feature], codes: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """What a tree says about each column of the codes."""
    slots, cuts, links, leaves = tree
    owner = np.repeat(np.arange(len(features)), [f.width or 1 for f in features])
    starts_at, is_number = np.array([f.slot for f in features]), np.array([not f.width for f in features])
    at = np.zeros(codes.shape[1], np.int64)
    moving = np.flatnonzero(slots[at] >= 0)
    while len(moving):
        here = at[moving]
        slot = slots[here]
        of = owner[slot]
        code = codes[of, moving]
        at[moving] = links[here] + np.where(is_number[of], code > cuts[here], code == slot - starts_at[of])
        moving = moving[slots[at[moving]] >= 0]
    return leaves[links[at]]


_ROWS: dict[str, tuple] = {}


class GrownForest:
    """A learner with ``fit``, whose trees are dealt to ``tasks`` tasks; forests that have the same ``turn`` are grown one after another."""

    def __init__(self, features: list[Feature], size: int, label: str, trees: int, seed: int, depth: int, least: int, bins: int, share: float | None, chosen: int, tasks: int, turn: Lock) -> None:
        self.features, self.size, self.label, self.trees, self.seed, self.tasks, self.turn = features, size, label, trees, seed, tasks, turn
        #: ``share`` of the rows are drawn without replacement; None: as many as there are, with replacement.
        self.depth, self.least, self.bins, self.share, self.chosen = depth, least, bins, share, chosen

    def fit(self, rows: DataFrame) -> GrownForestModel:
        numbers = [i for i, f in enumerate(self.features) if not f.width]
        pairs = [F.struct(F.lit(i).alias("i"), c(self.features[i].column).cast("double").alias("v")) for i in numbers]
        values: dict[int, tuple[list, list]] = {i: ([], []) for i in numbers}
        if numbers:  # a few bins' worth of values for each column
            for r in rows.select(F.explode(F.array(*pairs)).alias("x"), COUNT).groupBy("x.i", "x.v").agg(F.sum(COUNT).alias("n")).collect():
                values[r["i"]][0].append(r["v"])
                values[r["i"]][1].append(r["n"])
        features = [Feature(f.column, f.slot, f.width, [] if f.width else cut_points(*values[i], self.bins)) for i, f in enumerate(self.features)]
        center = rows.agg(F.sum(c(self.label) * c(COUNT)) / F.sum(COUNT)).first()[0]
        with self.turn:
            trees = stage(self._grown(rows, features, center), "trees")
        return GrownForestModel(trees, features, self.size, center)

    def _grown(self, rows: DataFrame, features: list[Feature], center: float) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *columns, label, n = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
                codes = [f.coded(x).tobytes() for f, x in zip(features, columns, strict=True)]
                row = [b"".join(codes), (label - center).tobytes(), n.astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["codes", "labels", "n"])

        read = rows.select(*[c(f.column).cast("double") for f in features], c(self.label).cast("double"), COUNT)
        parts = _sent(read.mapInArrow(pack, "codes binary, labels binary, n binary"))
        name, seed, share, depth, least, chosen, size = uuid.uuid4().hex, self.seed, self.share, self.depth, self.least, self.chosen, self.size
        schema = pa.schema([("tree", pa.int32()), *[(x, pa.binary()) for x in ("slots", "cuts", "links", "leaves")], ("gains", pa.list_(pa.float64()))])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _ROWS:  # a worker keeps the rows of one forest only
                _ROWS.clear()
                _ROWS[name] = _unpacked(parts, features)
            cells, codes, labels, counts = _ROWS[name]
            for batch in batches:
                for tree in batch.column(0).to_pylist():
                    rng = np.random.default_rng([seed, tree])
                    drawn = rng.poisson(counts) if share is None else rng.binomial(counts, share)
                    weight, total = np.bincount(cells, drawn, codes.shape[1]), np.bincount(cells, drawn * labels, codes.shape[1])
                    some = weight > 0
                    if not some.any():  # no row was drawn
                        some, weight = np.array([True]), np.array([1.0])
                        total = np.zeros(1)
                    own = codes[:, : len(some)][:, some]
                    *nodes, gains = grow(features, list(own), weight[some], total[some], depth, least, chosen, size, rng)
                    row = [[tree], *[[x.tobytes()] for x in nodes], [(gains / (gains.sum() or 1)).tolist()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        return rows.sparkSession.range(0, self.trees, 1, min(self.tasks, self.trees)).mapInArrow(work, _TREES)


def _sent(packed: DataFrame) -> list[Broadcast]:
    """Rows of binary columns, sent to the executors in parts; the driver holds one at a time."""
    context, sent, part, held = packed.sparkSession.sparkContext, [], [], 0
    for r in packed.toLocalIterator():  # a partition at a time
        part.append(tuple(bytes(x) for x in r))
        held += sum(map(len, part[-1]))
        if held > _SENT_BYTES:
            sent.append(context.broadcast(part))
            part, held = [], 0
    return [*sent, context.broadcast(part)] if part else sent


def _received(part: Broadcast) -> list[tuple[bytes, ...]]:
    """A part, which the worker forgets again: the next use reads it anew."""
    found = part.value
    vars(part).pop("_value", None)
    return found


def _unpacked(parts: list[Broadcast], features: list[Feature]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each counted row, the codes of each cell (a row for each feature), and labels and counts of the rows."""
    codes, labels, counts = [], [], []
    for part in parts:
        for x, y, n in _received(part):
            codes.append(np.frombuffer(x, np.uint16).reshape(len(features), -1))
            labels.append(np.frombuffer(y))
            counts.append(np.frombuffer(n, np.int64))
    codes, labels, counts = np.concatenate(codes, axis=1), np.concatenate(labels), np.concatenate(counts)
    # In one order, however the rows were dealt, so that a tree is the same in every task and each time.
    order = np.lexsort((labels, *codes))
    codes, labels, counts = codes[:, order], labels[order], counts[order]
    new = np.append(True, (codes[:, 1:] != codes[:, :-1]).any(axis=0))
    return np.cumsum(new) - 1, codes[:, new], labels, counts


class _Known:
    """Predictions of cells that a task has met."""

    def __init__(self, features: list[Feature], trees: list[Broadcast], count: int, center: float) -> None:
        self.features, self.trees, self.count, self.center = features, trees, count, center
        self.keys, self.found = np.zeros(0, np.int64), np.zeros(0)
        #: Whether the codes of a row make a number.
        self.narrow = np.prod([float(f.codes) for f in features]) < 2**62

    def predict(self, codes: np.ndarray) -> np.ndarray:
        if not self.narrow:
            cells, inverse = np.unique(codes, axis=1, return_inverse=True)
            return self._walk(cells)[inverse.ravel()]
        keys = np.zeros(codes.shape[1], np.int64)
        for f, x in zip(self.features, codes, strict=True):
            keys = keys * f.codes + x
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            if len(self.keys) > _KEPT_CELLS:
                self.keys, self.found, new = self.keys[:0], self.found[:0], np.ones(len(keys), bool)
            known, found = np.append(self.keys, keys[new]), np.append(self.found, self._walk(codes[:, first[new]]))
            order = np.argsort(known)
            self.keys, self.found = known[order], found[order]
        return self.found[np.searchsorted(self.keys, keys)][inverse]

    def _walk(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(codes.shape[1])
        for part in self.trees:
            for slots, cuts, links, leaves in _received(part):
                nodes = np.frombuffer(slots, np.int16), np.frombuffer(cuts, np.uint16), np.frombuffer(links, np.int32), np.frombuffer(leaves)
                total += walk(self.features, codes, nodes)
        return total / self.count + self.center


class GrownForestModel(Model, MLWritable, MLReadable):
    """The mean of trees that are stored as a table."""

    #: As Spark names a forest for numbers.
    kind = "RandomForestRegressionModel"

    def __init__(self, trees: DataFrame | None = None, features: list[Feature] | None = None, size: int = 0, center: float = 0.0) -> None:
        super().__init__()
        self.trees, self.features, self.size, self.center = trees, features or [], size, center
        self._parts: tuple[list[Broadcast], int] | None = None

    @property
    def getNumTrees(self) -> int:
        return self.trees.count()

    @property
    def featureImportances(self) -> DenseVector:
        """The mean over the trees, with a sum of 1 as in Spark."""
        total = np.zeros(self.size)
        for r in self.trees.select("gains").toLocalIterator():
            total += r["gains"]
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._parts is None:
            self._parts = _sent(self.trees.select("slots", "cuts", "links", "leaves")), self.getNumTrees
        features, (trees, count), center = self.features, self._parts, self.center

        def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            known = _Known(features, trees, count, center)
            for columns in batches:
                codes = [f.coded(x.to_numpy()) for f, x in zip(features, columns, strict=True)]
                yield pd.Series(known.predict(np.stack(codes)) if len(codes[0]) else np.zeros(0))

        predicted = F.pandas_udf(predict, "double")(*[c(f.column).cast("double") for f in features])
        return dataset.withColumn("prediction", predicted)

    def write(self) -> MLWriter:
        return _GrownWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _GrownReader()


class _GrownWriter(MLWriter):
    def __init__(self, instance: GrownForestModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        x = self.instance
        facts = {"features": [asdict(f) for f in x.features], "size": x.size, "center": x.center}
        DefaultParamsWriter.saveMetadata(x, path, self.sparkSession, extraMetadata=facts)
        x.trees.write.parquet(f"{path}/trees")


class _GrownReader(MLReader):
    def load(self, path: str) -> GrownForestModel:
        spark = SparkSession.getActiveSession() or self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        trees = spark.read.schema(_TREES).parquet(f"{path}/trees")
        found = GrownForestModel(trees, [Feature(**f) for f in metadata["features"]], metadata["size"], metadata["center"])
        found._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(found, metadata)
        return found
