"""Token counts, with huge texts encoded in overlapping chunks.

A text of more than ``chars`` code points becomes rows of overlapping chunks, cut in one pass, which go to different tasks.
Each chunk is encoded with offsets and reports the token borders in its overlaps, each with a print of the ``guard`` tokens on
both sides (ids and places in the text).  Neighbours are spliced at the first border that both report with the same print,
whether or not there is a space.  For byte pair encoding equal tokens around a border are a proof: a row of tokens is
the encoding of its word if each two neighbours are the encoding of what they hold, and after the splice each two neighbours are
neighbours in a chunk.  For other models the ``guard`` equal tokens are the evidence.  Where neighbours share no border, the text
is done again with overlaps eight times as wide, until one chunk holds it all; that takes a text whose borders depend on
where its encoding starts all along an overlap, such as one letter repeated.

A null text counts as an empty one, and an empty table gives an empty one.  Rows are counted one by one; repeated rows, also huge
ones, all come back.  Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm.common import SLICE_BYTES, id_type, map_columns, slices
from tidemill.llm.units import broadcast_file, load
from tidemill.session import stage


@dataclass(frozen=True)
class Chunks:
    chars: int = 65_536
    overlap: int = 1_024
    guard: int = 8


def count_tokens(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunks: Chunks = Chunks()
) -> DataFrame:
    """Bytes and tokens of each row, and whether there are more than ``limit`` tokens."""
    data = broadcast_file(df.sparkSession, vocabulary)
    rows = df.select(c(id_col).alias("id"), F.coalesce(c(text_col), F.lit("")).alias("text"))
    kind = id_type(df, id_col)

    def whole(ids, texts):
        return [ids, [len(t.encode("utf-8", "replace")) for t in texts], [len(x) // 4 for x in load(data.value).packed(texts)]]

    small = map_columns(rows.where(F.length("text") <= chunks.chars), ["id", "text"], f"id {kind}, n_bytes long, n_tokens long", whole)
    found = small.unionByName(_huge(rows.where(F.length("text") > chunks.chars), kind, data, chunks))
    return found.select(c("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _huge(rows: DataFrame, kind: str, data, chunks: Chunks) -> DataFrame:
    rows = rows.withColumn("text_key", F.md5("text"))
    overlap, done = chunks.overlap, None
    while True:
        result = stage(_spliced(rows, kind, data, chunks, overlap), "tokens")
        good = result.where("n_tokens IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        failed = result.where("n_tokens IS NULL").select("text_key").distinct()
        if failed.isEmpty():
            return done.select("id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
        rows, overlap = rows.join(failed, "text_key", "left_semi"), overlap * 8


def _pieces(rows: DataFrame, step: int, overlap: int) -> DataFrame:
    """Chunks of ``step + overlap`` code points that start every ``step``, until one reaches the end of the text."""
    names = ["id", "text_key", "text"]
    schema = rows.select(*names).schema.add("n_bytes", "long").add("size", "integer").add("start", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (x for b in batches for part in slices(b) for x in (part.slice(i, 1) for i in range(part.num_rows))):
            text = row.column(2)[0].as_py()
            n_bytes, size = len(text.encode("utf-8", "replace")), len(text)
            starts = range(0, max(1, size - overlap), step)  # none begins where another already reaches the end
            several = max(1, SLICE_BYTES // (4 * (step + overlap)))
            for i in range(0, len(starts), several):
                some = starts[i : i + several]
                texts = [text[k : k + step + overlap] for k in some]
                same = [x.take(pa.array([0] * len(some))) for x in (row.column(0), row.column(1))]
                counts = [pa.array([x] * len(some), kind) for x, kind in ((n_bytes, pa.int64()), (size, pa.int32()))]
                arrays = [*same, pa.array(texts, row.column(2).type), *counts, pa.array(list(some), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.select(*names).mapInArrow(run, schema)


def _spliced(rows: DataFrame, kind: str, data, chunks: Chunks, overlap: int) -> DataFrame:
    step, guard = chunks.chars, chunks.guard
    pieces = _pieces(rows, step, overlap).repartition(c("text_key"), c("start"))

    def encode(ids, keys, n_bytes, sizes, texts, starts):
        heads, tails, totals = [], [], []
        for text, start, size in zip(texts, starts, sizes, strict=True):
            spans = load(data.value).spans(text)
            open_end = start + len(text) < size
            heads.append(_borders(spans, 0, overlap, guard, start, open_end) if start else _NONE)
            tails.append(_borders(spans, step, step + overlap, guard, start, open_end) if open_end else _NONE)
            totals.append(len(spans))
        return [ids, keys, n_bytes, sizes, starts, heads, tails, totals]

    borders = "struct<prints: array<long>, before: array<long>>"
    schema = f"id {kind}, text_key string, n_bytes long, size int, start int, heads {borders}, tails {borders}, total long"
    encoded = map_columns(pieces, ["id", "text_key", "n_bytes", "size", "text", "start"], schema, encode)
    same = encoded.groupBy("id", "text_key", "n_bytes", "size", "start").agg(F.first(F.struct("heads", "tails", "total")).alias("x"), F.count(F.lit(1)).alias("copies"))
    following = F.lead("x.heads").over(Window.partitionBy("id", "text_key").orderBy("start"))
    pairs = same.select("*", following.alias("next"))
    common = F.get(F.array_intersect("x.tails.prints", "next.prints"), F.lit(0))
    pairs = pairs.select("*", F.col("next").isNull().alias("last"), common.alias("common"))
    here, there = (F.expr(f"get({x}.before, CAST(array_position({x}.prints, common) AS INT) - 1)") for x in ("x.tails", "next"))
    tokens = F.when(F.col("last"), F.col("x.total")).otherwise(here - there)
    whole = F.count(F.lit(1)) == F.count(tokens)
    return pairs.groupBy("id", "text_key", "n_bytes").agg(F.max("copies").alias("copies"), F.when(whole, F.sum(tokens)).alias("n_tokens"))


_NONE = {"prints": [], "before": []}


def _borders(spans: np.ndarray, low: int, high: int, guard: int, start: int, open_end: bool) -> dict:
    """The token borders of a chunk between ``low`` and ``high``: a print of place and neighbours, and the tokens before."""
    begins = spans[:, 0]
    first, end = (int(np.searchsorted(begins, x)) for x in (low, high))
    first = max(first, guard if start else 1)
    end = min(end, len(spans) - guard + 1 if open_end else len(spans))
    placed = spans + np.array([start, start, 0])
    # The place in the upper half, so that equal neighbours elsewhere have another print.
    prints = [(start + int(begins[k])) << 32 | zlib.crc32(placed[max(0, k - guard) : k + guard].tobytes()) for k in range(first, end)]
    return {"prints": prints, "before": list(range(first, first + len(prints)))}
