"""Best-fit packing of tokenised texts into sequences, planned by a configuration linear program.

Texts are encoded once; those longer than a sequence are cut into whole sequences and a rest.  All that the plan needs
is the histogram of piece lengths, at most ``capacity`` numbers, whatever the number of texts.  A configuration
is a multiset of lengths that fits a sequence; the linear program asks for the fewest configurations, in fractions, that cover the
histogram.  It is solved by multiplicative weights: every length has a price, which starts at a ``power`` of the length and falls
exponentially as the length gets covered; a knapsack dynamic program finds a configuration of the highest price
(over lengths rounded up to ``cells``; exchanges and additions then fill the room that is left), and as much of it
is taken as covers a ``step`` of one of its lengths.  The fractions are rounded: whole parts first, then single
sequences of the largest rests as far as pieces are left; what remains is packed longest first, a whole group of equal sequences at a time.

The pieces of one length are interchangeable, so a piece's sequence and offset follow from its number among the pieces
of its length: its number within its stored part, found while writing, plus those in earlier parts.  No step sorts or
gathers pieces, and a length that a third of all pieces share is as cheap as any other.

A null or empty text has the end id only.  Repeated rows and ids are packed one by one; null ids stay null; other columns are not
read.  An empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm.common import id_type, slices
from tidemill.llm.units import broadcast_file, load
from tidemill.session import stage

#: Parts times lengths whose offsets are sent to the executors (about 200 bytes each); beyond it they are joined.
BROADCAST_OFFSETS = 200_000
_RANKS = 1 << 48  # more than there are pieces of one length


@dataclass(frozen=True)
class Packing:
    capacity: int = 4096
    end_id: int = 1
    cells: int = 64
    rounds: int = 3_000
    step: float = 0.5
    fall: float = 1.0
    power: float = 2.0


@dataclass(frozen=True)
class Plan:
    """Places for pieces: entry ``e`` is for pieces of a length from a number on, ``each`` of them a sequence."""

    keys: np.ndarray  # length and first number, sorted
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    at_least: int  # no packing has fewer

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = lengths * _RANKS + numbers
        e = np.searchsorted(self.keys, keys, "right") - 1
        local = keys - self.keys[e]
        return self.sequence[e] + local // self.each[e], self.offset[e] + local % self.each[e] * lengths


class _Knapsack:
    """Multisets of cell sizes of the highest total price, by dynamic programming over the room."""

    def __init__(self, capacity: int, cells: int) -> None:
        self.cells = min(cells, capacity)
        self.size = -(-np.arange(capacity + 1) * self.cells // capacity)  # cells that a length needs
        self.first = np.searchsorted(self.size, np.arange(self.cells + 2))

    def best(self, prices: np.ndarray) -> dict[int, int]:
        """Counts by length.  Lengths with a price of 0 are not used."""
        tops, values = [], []
        for s in range(1, self.cells + 1):
            low, high = self.first[s], self.first[s + 1]
            top = low + int(prices[low:high].argmax()) if high > low else 0
            tops.append(top)
            values.append(prices[top] if high > low else 0.0)
        value = np.array(values)
        sizes = np.flatnonzero(value) + 1
        value = value[sizes - 1]
        best, choice = np.zeros(self.cells + 1), np.zeros(self.cells + 1, np.int64)
        for room in range(1, self.cells + 1):
            n = int(np.searchsorted(sizes, room, "right"))
            if n:
                total = value[:n] + best[room - sizes[:n]]
                k = int(total.argmax())
                best[room], choice[room] = total[k], sizes[k]
        counts: dict[int, int] = {}
        room = self.cells
        while room and choice[room]:
            length = tops[choice[room] - 1]
            counts[length] = counts.get(length, 0) + 1
            room -= int(choice[room])
        return counts


def _filled(counts: dict[int, int], left: np.ndarray, capacity: int) -> dict[int, int]:
    """A configuration whose room is filled: first one length at a time gives way to the longest that fits in its place,
    then the longest lengths that fit are added.  Only lengths that ``left`` has enough of are used."""
    room = capacity - sum(k * n for k, n in counts.items())
    lengths = np.flatnonzero(left)

    def longest(most: int) -> int:
        at = int(np.searchsorted(lengths, most, "right")) - 1
        while at >= 0 and counts.get(int(lengths[at]), 0) >= left[lengths[at]]:
            at -= 1
        return int(lengths[at]) if at >= 0 else 0

    for length in sorted(counts):
        if room and (other := longest(length + room)) > length:
            room -= other - length
            counts[length] -= 1
            if not counts[length]:
                del counts[length]
            counts[other] = counts.get(other, 0) + 1
    while room and (length := longest(room)):
        more = min(int(left[length]) - counts.get(length, 0), room // length)
        counts[length] = counts.get(length, 0) + more
        room -= more * length
    return counts


def fractions(histogram: np.ndarray, packing: Packing) -> list[tuple[dict[int, int], float]]:
    """Configurations and how much of each covers the histogram, by multiplicative weights."""
    wanted = histogram.astype(np.float64)
    covered = np.zeros(len(wanted))
    knapsack = _Knapsack(packing.capacity, packing.cells)
    taken: dict[tuple[tuple[int, int], ...], float] = {}
    start = np.arange(len(wanted), dtype=np.float64) ** packing.power
    prices = np.where(wanted > 0, start, 0.0)
    for _ in range(packing.rounds):
        if not prices.any():
            break
        counts = _filled(knapsack.best(prices), np.where(prices > 0, histogram, 0), packing.capacity)
        lengths, each = np.array(list(counts), np.int64), np.array(list(counts.values()), np.float64)
        amount = float((np.maximum(wanted[lengths] * packing.step, 0.5) / each).min())
        key = tuple(sorted(counts.items(), reverse=True))
        taken[key] = taken.get(key, 0.0) + amount
        covered[lengths] += amount * each / wanted[lengths]
        prices[lengths] = np.where(covered[lengths] < 1 - 1e-9, start[lengths] * np.exp(-packing.fall * covered[lengths]), 0.0)
    return [(dict(key), amount) for key, amount in taken.items()]


def rounded(histogram: np.ndarray, solution: list[tuple[dict[int, int], float]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations that hold each piece exactly once."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []

    def take(counts: dict[int, int], most: int) -> int:
        n = min(most, min(int(left[k]) // a for k, a in counts.items()))
        if n > 0:
            for k, a in counts.items():
                left[k] -= n * a
            out.append((counts, n))
        return max(n, 0)

    rests = []
    for counts, amount in solution:
        rests.append((amount - take(counts, int(amount)), counts))
    for _, counts in sorted(rests, key=lambda x: -x[0]):
        take(counts, 1)
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        each = min(capacity // longest, int(left[longest]))
        take(_filled({longest: each}, left, capacity), int(left[longest]))
    return out


def planned(histogram: np.ndarray, packing: Packing = Packing()) -> Plan:
    """``histogram[k]`` pieces of length ``k``, from 0 (none) to the capacity."""
    capacity = packing.capacity
    parts = rounded(histogram, fractions(histogram, packing), capacity)
    rows: list[tuple[int, int, int, int]] = []
    numbers = [0] * (capacity + 1)
    sequence = 0
    for counts, n in parts:
        offset = 0
        for length in sorted(counts, reverse=True):
            rows.append((length * _RANKS + numbers[length], counts[length], sequence, offset))
            numbers[length] += n * counts[length]
            offset += length * counts[length]
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    total = sum(int(n) * k for k, n in enumerate(histogram.tolist()))
    at_least = max(-(-total // capacity), int(histogram[capacity // 2 + 1 :].sum()))
    return Plan(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy(), sequence, at_least)


def cut(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", packing: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its part and its number among the part's pieces of its length; ``ids`` if wanted."""
    data = broadcast_file(df.sparkSession, vocabulary)
    capacity, end = packing.capacity, np.array([packing.end_id], "<u4").tobytes()
    fields = [("id", None), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("number", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in (x for b in batches for x in slices(b)):
            out: list[list] = [[] for _ in range(6)]
            raw = []
            encoded = load(data.value).packed([t or "" for t in batch.column(1).to_pylist()])
            for row, ids in enumerate(encoded):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    for values, x in zip(out, (row, piece, at // 4, length, zlib.crc32(own), seen[length]), strict=True):
                        values.append(x)
                    seen[length] += 1
                    if with_ids:
                        raw.append(own)
            rows, piece, start, length, crc, number = out
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(x, kind) for x, (_, kind) in zip((piece, start, length, crc, [part] * len(rows), number), fields[1:], strict=True)]
            names = [n for n, _ in fields]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(raw, pa.binary())], names=[*names, "ids"]) if with_ids else pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {id_type(df, id_col)}, piece int, start long, length long, ids_crc32 long, part int, number long" + (", ids binary" if with_ids else "")
    return df.select(c(id_col).alias("id"), c(text_col).alias("text")).mapInArrow(run, schema)


def pack(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", packing: Packing = Packing(), with_ids: bool = False,
    broadcast_offsets: int = BROADCAST_OFFSETS,
) -> DataFrame:
    """Each piece's ``sequence_id`` and ``offset``, with ``piece``, ``start``, ``length`` and ``ids_crc32``, and its ids if wanted."""
    pieces = stage(cut(df, vocabulary, id_col, text_col, packing, with_ids), "pieces")
    held = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(held.select("part", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "piece-offsets")
    histogram = np.zeros(packing.capacity + 1, np.int64)
    for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        histogram[r["length"]] = r["n"]
    plan = df.sparkSession.sparkContext.broadcast(planned(histogram, packing))
    before = offsets.select("part", "length", "before")
    rows = pieces.join(F.broadcast(before) if before.count() <= broadcast_offsets else before, ["part", "length"])
    given = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = dict(pieces.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(len(given)).to_numpy()
            sequence, offset = plan.value.place(batch.column(3).to_numpy(), number)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(given)], pa.array(sequence), pa.array(offset)], names=[*given, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {kinds[n]}" for n in given) + ", sequence_id long, offset long"
    placed = rows.select(*given, (F.col("number") + F.col("before")).alias("number")).mapInArrow(run, schema)
    return placed.select(c("id").alias(id_col), *given[1:], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence (little-endian unsigned 32-bit) of pieces packed ``with_ids``; a sequence is never larger than the capacity."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(pieces, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("n_ids"), joined.alias("ids"))
