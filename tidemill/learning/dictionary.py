"""Dictionaries as tables: the position of each value in its sort order, and looking values up by a join.

Neither needs the values on the driver.  Positions come from a range-sorted copy: a value's number within its
part plus the values in earlier parts; no task sorts more than one part, and no window sees more than one row for each part.
"""

from __future__ import annotations

from typing import Any

from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.session import stage

#: A table with at most so many rows is sent to the executors when it is looked up.
BROADCAST_ROWS = 200_000
_PART_BITS = 33  # monotonically_increasing_id: the part above, the row's number in it below


def with_positions(values: DataFrame, group: str, key: str) -> DataFrame:
    """``position`` of each row in the order of ``key`` within its ``group``; keys of a group are distinct."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = values.repartitionByRange(parts, c(group), c(key)).sortWithinPartitions(c(group), c(key))
    stored = stage(ranged.withColumn("__at", F.monotonically_increasing_id()), "dictionary")
    stored = stored.withColumn("__part", F.shiftright("__at", _PART_BITS))
    held = stored.groupBy("__part", c(group)).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__m"))
    earlier = Window.partitionBy(c(group)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__m").over(earlier), F.lit(0)) - F.col("__first")
    # At most as many rows as there are parts and groups together.
    shifts = F.broadcast(held.select("__part", c(group), shift.alias("__shift")))
    placed = stored.join(shifts, ["__part", group])
    return placed.select(*[c(n) for n in values.columns], (F.col("__at") + F.col("__shift")).alias("position"))


class TableLookup(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Adds the value that a table (``key``, ``value``) has for a column; ``default`` where it has none.

    A table of a counted, small size is broadcast; a larger one is joined by a shuffle, where AQE splits hot keys.
    """

    def __init__(self, input_col: str | None = None, output_col: str | None = None, table: DataFrame | None = None, default: Any = None) -> None:
        super().__init__()
        self.table, self.default = table, default
        self.rows = table.count() if table is not None else 0
        if input_col and output_col:
            self._set(inputCol=input_col, outputCol=output_col)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, value = f"__key_of_{self.getOutputCol()}", f"__value_of_{self.getOutputCol()}"
        side = self.table.select(c("key").alias(key), c("value").alias(value))
        joined = dataset.join(F.broadcast(side) if self.rows <= BROADCAST_ROWS else side, c(self.getInputCol()) == c(key), "left")
        found = c(value) if self.default is None else F.coalesce(c(value), F.lit(self.default))
        return joined.withColumn(self.getOutputCol(), found).drop(key, value)

    def write(self) -> MLWriter:
        return _LookupWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LookupReader()


class _LookupWriter(MLWriter):
    def __init__(self, instance: TableLookup) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"default": self.instance.default})
        self.instance.table.select("key", "value").write.parquet(f"{path}/table")


class _LookupReader(MLReader):
    def load(self, path: str) -> TableLookup:
        spark = SparkSession.getActiveSession() or self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        found = TableLookup(table=spark.read.parquet(f"{path}/table"), default=metadata["default"])
        found._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(found, metadata)
        return found
