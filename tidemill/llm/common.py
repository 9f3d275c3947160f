"""What several operators share: Arrow maps over chosen columns, and bounded slices of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemill.columns import c

#: Batches are worked on in slices of about so many bytes (or one row), however many rows Arrow sends at once.
SLICE_BYTES = 2_000_000


def map_columns(df: DataFrame, names: list[str], schema: str, work: Callable[..., list]) -> DataFrame:
    """Apply ``work`` to lists of the named columns, batch by batch; it returns the lists of the output columns.

    Only the named columns reach Python.  There is no shuffle, and a lost task is run again from its input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = work(*[x.to_pylist() for x in part.columns])
                arrays = [pa.array(values, type=kind) for values, kind in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=outputs)

    target = df.sparkSession.createDataFrame([], schema).schema
    outputs, kinds = target.fieldNames(), [_arrow(f.dataType) for f in target.fields]
    return df.select(*[c(n) for n in names]).mapInArrow(run, target)


def keep_rows(df: DataFrame, name: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows, with all their columns, for whose value in column ``name`` ``keep`` says so."""
    at = df.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that the table, whose names ignore case, doesn't have: underscores are added."""
    taken = {n.lower() for n in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def slices(batch: pa.RecordBatch, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that hold about ``size`` (SLICE_BYTES) bytes, or one row.

    Cut by the offsets of the Arrow columns, so that only one slice at a time becomes Python objects.
    """
    size = size or SLICE_BYTES
    held = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        held += _sizes(column)
    ends = np.cumsum(held)
    start = done = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(start, end - start)
        start, done = end, int(ends[end - 1])


def _sizes(column: pa.Array) -> np.ndarray:
    """About how many bytes each row has."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return 8 * pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), 8)
