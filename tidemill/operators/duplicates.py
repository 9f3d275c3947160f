"""Equal rows: counting and removing them.

Grouping whole rows shuffles the whole table.  On a large table, rows are first
grouped by a 64-bit hash, which shuffles eight bytes per row.  A hash that occurs once
proves its row unique; only rows sharing a hash are compared in full, which also
settles hash collisions.  Up to MAX_REPEATED repeated hashes are broadcast as they are;
beyond that a blocked Bloom filter of them is (FILTER_BYTES at most), so that a row it
rules out never moves, and only repeated rows and a few false positives are grouped.
Equal rows are combined per task first, so however often a row occurs, it costs one
record per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.columns import c
from tidemill.roles import ROW, data_columns, dtype_of
from tidemill.session import stage

#: Name of the helper column with the number of equal rows.
COPIES = "_copies"
#: Tables with at most this many rows are grouped directly.
SMALL_ROWS = 5_000_000
#: Most repeated hashes that are broadcast (eight bytes each).
MAX_REPEATED = 1_000_000
#: Most bytes of the filter that stands for more of them.
FILTER_BYTES = 64 << 20
_HASH = "_hash"
# A block of the filter is 512 words of 64 bits; a hash sets four bits of one word, and has 16 bits where there is room.
_WORDS = 512
_BLOCK_BYTES = 8 * _WORDS
_BITS_PER_HASH = 16
_BLOCK, _BITS = "_block", "_bits"


def row_hash(df: DataFrame, names: Sequence[str]) -> Column:
    """A 64-bit hash of whole rows; equal rows have equal hashes."""
    floats = (T.FloatType, T.DoubleType)
    # Adding zero turns -0.0 into 0.0, which grouping treats as the same value.
    return F.xxhash64(*[c(n) + F.lit(0) if isinstance(dtype_of(df, n), floats) else c(n) for n in names])


def repeated_hashes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The hashes occurring more than once, stored."""
    hashes = df.select(row_hash(df, names).alias(_HASH)).groupBy(_HASH).agg(F.count(F.lit(1)).alias("n"))
    return stage(hashes.filter(F.col("n") > 1).select(_HASH), "repeated-hashes")


def _place(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a hash, its word there, and the bits that it sets in that word."""
    other = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(other, 9 + 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    word = other.bitwiseAND(F.lit(_WORDS - 1)).cast("int")
    return F.pmod(key, F.lit(blocks)), word, bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def hash_filter(repeated: DataFrame, hashes: int, limit: int) -> tuple[DataFrame, int]:
    """A blocked Bloom filter: a row per block with its words, and the number of blocks, at most ``limit`` bytes."""
    blocks = max(1, min(hashes * _BITS_PER_HASH // (8 * _BLOCK_BYTES) + 1, limit // _BLOCK_BYTES))
    block, word, bits = _place(c(_HASH), blocks)
    # Blocks and words that no hash falls into have to be there too.
    every = repeated.sparkSession.range(blocks * _WORDS)
    zeros = every.select(F.floor(F.col("id") / _WORDS).alias(_BLOCK), (F.col("id") % _WORDS).cast("int").alias("word"), F.lit(0).cast("bigint").alias(_BITS))
    marks = zeros.unionByName(repeated.select(block.alias(_BLOCK), word.alias("word"), bits.alias(_BITS)))
    words = marks.groupBy(_BLOCK, "word").agg(F.bit_or(_BITS).alias(_BITS))
    listed = F.array_sort(F.collect_list(F.struct("word", _BITS)))[_BITS].alias(_BITS)
    return stage(words.groupBy(_BLOCK).agg(listed), "hash-filter"), blocks


class Repeated:
    """Tells rows that may have equals from those that have none."""

    def __init__(self, df: DataFrame, names: Sequence[str], max_repeated: int | None, filter_bytes: int) -> None:
        self.names, self.table = names, repeated_hashes(df, names)
        count = self.table.count()
        self.blocks = None
        if count > (MAX_REPEATED if max_repeated is None else max_repeated):
            self.table, self.blocks = hash_filter(self.table, count, filter_bytes)

    def rows(self, df: DataFrame, shared: bool) -> DataFrame:
        """The rows whose hash is repeated (or may be, by the filter), or all the others."""
        # Helper columns get names that the table doesn't have.
        mark = "_" * (1 + max(len(n) for n in df.columns))
        key, bits = c(f"{mark}{_HASH}"), c(f"{mark}{_BITS}")
        known = self.table.select(*[c(n).alias(f"{mark}{n}") for n in self.table.columns])
        hashed = df.withColumn(f"{mark}{_HASH}", row_hash(df, self.names))
        if self.blocks is None:
            found = hashed.join(F.broadcast(known), f"{mark}{_HASH}", "left_semi" if shared else "left_anti")
        else:
            place, word, wanted = _place(key, self.blocks)
            held = F.get(bits, word).bitwiseAND(wanted) == wanted
            found = hashed.withColumn(f"{mark}{_BLOCK}", place).join(F.broadcast(known), f"{mark}{_BLOCK}")
            found = found.filter(held if shared else ~held)
        return found.select(*[c(n) for n in df.columns])


def group_rows(df: DataFrame, copies: str | None = None) -> DataFrame:
    """The first of equal rows by grouping whole rows, with their number if asked."""
    aggs = [F.min(c(ROW)).alias(ROW)] if ROW in df.columns else []
    if copies or not aggs:
        aggs.append(F.count(F.lit(1)).alias(copies or COPIES))
    groups = df.groupBy(*[c(n) for n in data_columns(df)]).agg(*aggs)
    return groups.select(*[c(n) for n in [*df.columns, *([copies] if copies else [])]])


def drop_duplicates(
    df: DataFrame,
    copies: str | None = None,
    rows: int | None = None,
    small_rows: int = SMALL_ROWS,
    max_repeated: int | None = None,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Keep the first of equal rows.

    ``copies`` names an optional column with the number of equal rows; ``rows``
    passes the row count, without which the table is grouped directly.
    """
    names = data_columns(df)
    if rows is None or rows <= small_rows:
        return group_rows(df, copies)
    repeated = Repeated(df, names, max_repeated, filter_bytes)
    unique = repeated.rows(df, shared=False)
    if copies:
        unique = unique.withColumn(copies, F.lit(1).cast("bigint"))
    return unique.unionByName(group_rows(repeated.rows(df, shared=True), copies))


def duplicate_rows(
    df: DataFrame, rows: int | None = None, small_rows: int = SMALL_ROWS, max_repeated: int | None = None, filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """``duplicate_rows``: rows beyond the first of each distinct full row."""
    names = data_columns(df)
    if rows is not None and rows > small_rows:
        df = Repeated(df, names, max_repeated, filter_bytes).rows(df, shared=True)
    keys = [c(n).alias(f"v{i}") for i, n in enumerate(names)]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
