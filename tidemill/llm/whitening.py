"""Whitening of embeddings: distributed centred covariance, leading eigenvectors, broadcast projection.

An entry ``c`` becomes the whole number ``floor(scale * c) + shift``.  The fit list has each different vector once, so
copies do not weigh more; it is made by grouping on the vector's own bytes (in the narrowest integers that hold it) and
stored.  Sums of entries are exact; entries are centred before they are multiplied; tasks send one row of sums for each dimension,
and rows of one dimension are added up by Spark.  The driver sees only sums over all rows: dimensions squared, whatever
the number of rows.  It finds the leading eigenvectors (``eigen``), and one map projects every row on them.

Rows whose vector is null or empty, or has null or non-finite entries, are left out.  So are vectors of another length than the
commonest one of the fit list (the longest of equals).  Entries beyond 2**61 count as 2**61.  Components whose eigenvalue can't be told from
zero don't exist: a table without rows, or with one vector only, has none.  A deviation beyond 64 bits is null.
Repeated rows and null ids all come back; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm import eigen
from tidemill.llm.common import id_type
from tidemill.session import stage

#: Entries of vectors that are worked on at once.
SLICE_ENTRIES = 2_000_000
_MOST = 2**61
_WIDTHS = (1, 2, 4, 8)


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: ``n`` vectors, their exact sums, and the components as rows."""

    n: int
    sums: list[int]  # of floor(scale * c), without the shift
    values: np.ndarray
    components: np.ndarray
    trace: float
    scale: float
    identity_error: float | None = None

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and the rest, so that centring loses nothing."""
        whole = [round(s / self.n) if abs(s) < 2**52 else s // self.n for s in self.sums]
        rest = [(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)]
        return np.array(whole, np.int64), np.array(rest)

    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def projection(self) -> np.ndarray:
        """One column for each component."""
        return self.components.T / np.sqrt(self.values)


def vectors(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of good rows of one length, with ``floor(scale * c)`` as a matrix, in bounded slices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()  # of the rows that aren't null
    entries = flat.fill_null(np.nan).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    for size in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == size))
        step = max(1, SLICE_ENTRIES // size)
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            table = entries[(ends[part] - size)[:, None] + np.arange(size)].astype(np.float64)
            yield part, np.clip(np.floor(table * scale), -_MOST, _MOST).astype(np.int64)


def packed(table: np.ndarray) -> list[bytes]:
    """Each different row as bytes: the width of its integers, then the integers.  Equal rows have equal bytes."""
    out: list[bytes] = []
    low, high = table.min(axis=1), table.max(axis=1)
    todo = np.ones(len(table), bool)
    for width in _WIDTHS:
        kind = np.iinfo(f"i{width}")
        own = todo & (low >= kind.min) & (high <= kind.max)
        todo &= ~own
        rows = np.ascontiguousarray(table[own].astype(f"<i{width}"))
        if len(rows):
            different = np.unique(rows.view(f"V{rows.shape[1] * width}").ravel())
            out += [bytes([width]) + x.tobytes() for x in different]
    return out


def unpacked(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The rows again, as matrices of bounded size."""
    raw = column.to_pylist()
    step = max(1, SLICE_ENTRIES // size)
    for width in _WIDTHS:
        own = [x[1:] for x in raw if x[0] == width]
        for i in range(0, len(own), step):
            part = own[i : i + step]
            yield np.frombuffer(b"".join(part), f"<i{width}").reshape(len(part), size).astype(np.int64)


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 16, scale: float = 64.0) -> Whitening:
    """Covariance of the different vectors and its leading eigenvectors, with the error of the whitened covariance."""
    different = stage(_different(df, vec_col, scale), "whitening-fit")
    lengths = different.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    commonest = lengths.agg(F.max_by(F.struct("size", "n"), F.struct("n", "size")).alias("x")).first().x
    if commonest is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, scale)
    size, n = commonest["size"], commonest["n"]
    rows = different.where(F.col("size") == size).select("vector")
    found = Whitening(n, _sums(rows, size), np.zeros(0), np.zeros((0, size)), 0.0, scale)
    whole, rest = found.centre()
    covariance = _products(rows, size, lambda table: (table - whole) - rest, size) / n
    covariance = (covariance + covariance.T) / 2
    values, directions = eigen.leading(covariance, components)
    found = Whitening(n, found.sums, values, directions, float(np.trace(covariance)), scale)
    if not len(values):
        return found
    projection = found.projection()
    whitened = _products(rows, size, lambda table: ((table - whole) - rest) @ projection, len(values)) / n
    error = float(np.abs(whitened - np.eye(len(values))).max())
    return Whitening(n, found.sums, values, directions, found.trace, scale, error)


def transform(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Id, ``deviation`` (squared distance of ``n`` times the vector from the sums) and ``whitened``, an array, of each row."""
    size, n, k, scale = len(model.sums), model.n, len(model.values), model.scale
    # Bounded by the dimensions: the mean, the sums and at most a few columns.
    shared = df.sparkSession.sparkContext.broadcast((*model.centre(), model.projection(), model.sums) if size else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest, projection, sums = shared.value or (None,) * 4
        for batch in batches:
            for at, table in vectors(batch.column(1), scale):
                if table.shape[1] != size:
                    continue
                scores = ((table - whole) - rest) @ projection
                scores = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), scores.ravel())
                arrays = [batch.column(0).take(pa.array(at)), deviations(table, n, sums), scores]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "deviation", "whitened"])

    rows = df.select(c(id_col).alias("id"), c(vec_col).cast("array<double>").alias("vector"))
    out = rows.mapInArrow(run, f"id {id_type(df, id_col)}, deviation long, whitened array<double>")
    return out.select(c("id").alias(id_col), "deviation", "whitened")


def deviations(table: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact; in Python's integers where 64 bits might not do."""
    most = max(abs(int(table.min())), abs(int(table.max()))) * n + max(map(abs, sums))
    if most * most * len(sums) < 2**62:
        return pa.array(((table * n - np.array(sums, np.int64)) ** 2).sum(axis=1))
    exact = [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in table.tolist()]
    return pa.array([x if x < 2**63 else None for x in exact], pa.int64())


def _different(df: DataFrame, vec_col: str, scale: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, table in vectors(batch.column(0), scale):
                rows = packed(table)
                yield pa.RecordBatch.from_arrays([pa.array([table.shape[1]] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["size", "vector"])

    return df.select(c(vec_col).cast("array<double>").alias("vector")).mapInArrow(run, "size int, vector binary").distinct()


def _sums(rows: DataFrame, size: int) -> list[int]:
    """Exact sums for each dimension: a task's sums travel in two halves, so that adding them up stays in 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            for table in unpacked(batch.column(0), size):
                safe = int(np.abs(table).max()) * len(table) < _MOST
                part = table.sum(axis=0).tolist() if safe else [sum(x) for x in table.T.tolist()]
                total = [a + b for a, b in zip(total, part, strict=True)]
        if any(total):
            halves = [list(range(size)), [x >> 32 for x in total], [x & 0xFFFFFFFF for x in total]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in halves], names=["at", "high", "low"])

    added = rows.mapInArrow(run, "at long, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    total = [0] * size
    for r in added.collect():  # one row for each dimension
        total[r["at"]] = (r["high"] << 32) + r["low"]
    return total


def _products(rows: DataFrame, size: int, centred: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum, over all rows, of each centred row times itself; a task sends a row of sums for each dimension."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for table in unpacked(batch.column(0), size):
                table = centred(table)
                total += table.T @ table
        if total.any():
            yield _as_rows(range(width), total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0.0) + np.frombuffer(own)
        if total:
            yield _as_rows(total, total.values())

    added = rows.mapInArrow(multiply, "at int, sums binary").repartition("at").mapInArrow(add, "at int, sums binary")
    out = np.zeros((width, width))
    for r in added.collect():  # one row for each dimension
        out[r["at"]] = np.frombuffer(r["sums"])
    return out


def _as_rows(at, sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())], names=["at", "sums"])
