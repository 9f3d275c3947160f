"""Token-id files: blocks of ids behind an adaptive context-mixing range coder.

A segment holds whole texts and is a block that shares nothing with others: it has its own alphabet, model, code bytes and checksum.
Inside a block, order-2 and order-1 contexts each predict the id that has the most votes among those that followed them, and
their votes and the order-0 count of the predicted id are mixed (logistic mixing with learned weights) into the probability that
it comes next.  If it doesn't, adaptive order-0 counts code the id.  All arithmetic is on integers, so writing and reading agree on every machine.

The ids of a block are dealt to lanes, each a run of ids with a range coder of its own, and one id of each lane is coded
per step, with numpy.  All lanes feed and use the same model, which learns after rounds of a few steps, so that counts, votes and
the mixed probabilities are only worked out anew once a round.

Files are Parquet files with one segment a row: ``part`` and ``segment`` give its place in the order of ids, ``ids`` the
texts' own ids, ``data`` the bytes.  A null text counts as empty and has only the end id.  Rows are sorted by id, equal ids by a hash of the text; repeated
rows all come back; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm.common import id_type, map_columns, slices
from tidemill.llm.units import broadcast_file, load

#: Ids of a segment, unless one text has more.
SEGMENT = 2 * 1024 * 1024
#: Lanes of a block, and ids that make a lane worth its last bytes.
LANES, LANE_IDS = 4096, 512
#: The most steps between two times that the model learns; the first rounds are shorter.
ROUND = 32
_MAGIC = b"TMID\x02"
_HEAD = struct.Struct("<5sIIII")

_HASHED = 19  # bits of the number of order-2 contexts
_GAIN = 4  # what an id's coming adds to its order-0 weight, which is 1 before
_VOTES = 255
_CHANCE = 12  # bits of a probability
_ONE = np.uint64(1 << _CHANCE)
_16, _48 = np.uint64(16), np.uint64(48)
_LEAST = np.uint64(1 << 48)


def _stretch_table() -> np.ndarray:
    p = (np.arange(4096) + 0.5) / 4096
    return np.clip(np.rint(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int64)


def _squash_table() -> np.ndarray:
    x = np.arange(-2047, 2048) / 256
    return np.clip(np.rint(4096 / (1 + np.exp(-x))), 1, 4095).astype(np.int64)


_STRETCH, _SQUASH = _stretch_table(), _squash_table()
#: The class, from 1, of a number of votes; a context that hasn't come has class 0.
_CLASS = 1 + np.frexp(np.arange(_VOTES + 1.0))[1].astype(np.int32)
#: What is mixed: the class of the order-2 votes, whether both contexts predict the same id, the class of the order-1 votes, the level of the order-0 count.
_KINDS = (16, 2, 16, 16)
_KIND = np.arange(np.prod(_KINDS))
_INPUT = np.stack([_KIND >> 9, (_KIND >> 4) & 31, _KIND & 15], axis=1) + [0, 16, 48]
_NO_GUESS = ((_KIND >> 9) == 0) & (((_KIND >> 4) & 15) == 0)


class _Model:
    """The predictions of a block, whose ids are known by their places in its alphabet."""

    def __init__(self, alphabet: int, ids: int) -> None:
        self.size = alphabet
        self.bits = alphabet.bit_length() + 2  # of the order-0 code space
        self.mask = (1 << max(8, min(_HASHED, ids.bit_length()))) - 1
        contexts = (alphabet + 1, self.mask + 1)
        self.votes = [np.zeros(n, np.int32) for n in contexts]
        # The predicted id and the class of its votes; 0 if the context hasn't come.
        self.packed = [np.zeros(n, np.int32 if alphabet < 1 << 27 else np.int64) for n in contexts]
        self.weights = np.ones(alphabet, np.int64)
        self.came, self.right = np.full(64, 2, np.int64), np.ones(64, np.int64)  # of each input
        self.mix = np.full(3, 24_000, np.int64)
        self._settle()

    def _settle(self) -> None:
        """Work out what the coder looks up in the next round."""
        upto = np.cumsum(self.weights)
        ends = upto * ((1 << self.bits) - self.size) // upto[-1] + np.arange(1, self.size + 1)
        start = np.concatenate([[0], ends[:-1]])
        share = ends - start
        self.start, self.share = start.astype(np.uint64), share.astype(np.uint64)
        self.found = np.repeat(np.arange(self.size, dtype=np.int32), share)
        self.level = np.minimum(np.frexp(share.astype(np.float64))[1], 15).astype(np.int32)
        self.inputs = _STRETCH[np.minimum(self.right * 4096 // self.came, 4095)][_INPUT]
        mixed = np.clip((self.inputs * self.mix).sum(axis=1) >> 16, -2047, 2047)
        self.chances = np.where(_NO_GUESS, 0, _SQUASH[mixed + 2047])
        self.chance = self.chances.astype(np.uint64)

    def predict(self, s1: np.ndarray, s2: np.ndarray):
        """Order-2 contexts, what both contexts predict, the predicted ids, what is mixed, and the probability, of 4096, that the prediction is right (0: there is none)."""
        context = s2 * 40_503
        context += s1
        context *= 2_654_435_761
        context >>= 20
        context &= self.mask
        e1, e2 = self.packed[0].take(s1), self.packed[1].take(context)
        b2 = e2 & 15
        guess = np.where(b2 > 0, e2, e1)
        guess >>= 4
        kind = b2 << 9
        kind += (e1 & 15) << 4
        kind += np.multiply(e1 >> 4 == e2 >> 4, 256, dtype=kind.dtype)
        kind += self.level.take(guess)
        return context, e1, e2, guess, kind, self.chance.take(kind)

    def learn(self, s1: np.ndarray, context: np.ndarray, e1: np.ndarray, e2: np.ndarray, kind: np.ndarray, right: np.ndarray, symbols: np.ndarray) -> None:
        """The ids that came in a round."""
        self.weights += _GAIN * np.bincount(symbols, minlength=self.size)
        came, hit = np.bincount(kind, minlength=len(_KIND)), np.bincount(kind[right], minlength=len(_KIND))
        guessed = np.where(_NO_GUESS, 0, came)
        error = np.where(_NO_GUESS, 0, hit * 4095 - came * self.chances)
        self.mix += (self.inputs * error[:, None]).sum(axis=0) // max(1, int(guessed.sum())) * 40 >> 10
        for i in range(3):
            self.came += np.bincount(_INPUT[:, i], weights=guessed, minlength=64).astype(np.int64)
            self.right += np.bincount(_INPUT[:, i], weights=hit, minlength=64).astype(np.int64)
        for votes, packed, at, before in zip(self.votes, self.packed, (s1, context), (e1, e2), strict=True):
            np.add.at(votes, at, np.where((before >> 4 == symbols) & (before > 0), np.int32(1), np.int32(-1)))
            own = votes.take(at)
            lost = np.flatnonzero(own < 0)
            over = np.flatnonzero(own > _VOTES)
            votes[at[lost]] = own[lost] = 0
            votes[at[over]] = own[over] = _VOTES
            # All ids of a context lose or none does, and the last that came after it is predicted next.
            before &= -16
            before[lost] = symbols[lost] << 4
            before |= _CLASS.take(own)
            packed[at] = before
        self._settle()


class _Writer:
    """Range coders side by side: 64-bit ranges, 16 bits out at a time; carries are added to what is out in the end."""

    def __init__(self, lanes: int, words: int) -> None:
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.words = np.zeros((words, lanes), np.uint32)
        self.size = np.zeros(lanes, np.int64)

    def code(self, start: np.ndarray, share: np.ndarray, bits: np.uint64) -> None:
        """Narrow the first lanes to a part of their intervals."""
        n = len(start)
        low, width = self.low[:n], self.range[:n]
        width >>= bits
        add = width * start
        low += add
        width *= share
        carry = np.flatnonzero(low < add)
        if len(carry):
            self.words[self.size[carry] - 1, carry] += 1
        small = np.flatnonzero(width < _LEAST)
        while len(small):
            self._out(small)
            width[small] <<= _16
            small = small[width[small] < _LEAST]

    def _out(self, at: np.ndarray) -> None:
        low, size = self.low[at], self.size[at]
        self.words[size, at] = low >> _48
        self.low[at] = low << _16
        self.size[at] = size + 1

    def finish(self) -> tuple[np.ndarray, bytes]:
        """How many words each lane has, and the words lane by lane."""
        every = np.arange(len(self.low))
        for _ in range(4):
            self._out(every)
        for i in range(int(self.size.max()) - 1, 0, -1):
            self.words[i - 1] += self.words[i] >> 16
        lanes = np.empty(self.words.shape[::-1], "<u2")
        _turn(self.words.astype("<u2"), lanes)
        return self.size, lanes[np.arange(len(self.words)) < self.size[:, None]].tobytes()


class _Reader:
    def __init__(self, sizes: np.ndarray, data: bytes, words: int) -> None:
        self.words = np.concatenate([np.frombuffer(data, "<u2"), np.zeros(words + 4, np.uint16)]).astype(np.uint64)
        self.at = np.cumsum(sizes) - sizes
        self.range = np.full(len(sizes), 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.value = np.zeros(len(sizes), np.uint64)  # above the lower end
        for _ in range(4):
            self.value = (self.value << _16) | self.words[self.at]
            self.at += 1

    def target(self, n: int, bits: np.uint64) -> np.ndarray:
        """Where in their intervals the first lanes are; they must be narrowed to a part around it next."""
        width = self.range[:n]
        width >>= bits
        return np.minimum(self.value[:n] // width, np.uint64((1 << int(bits)) - 1))

    def code(self, start: np.ndarray, share: np.ndarray) -> None:
        n = len(start)
        value, width = self.value[:n], self.range[:n]
        value -= width * start
        width *= share
        small = np.flatnonzero(width < _LEAST)
        while len(small):
            at = self.at[small]
            value[small] = (value[small] << _16) | self.words.take(at)
            self.at[small] = at + 1
            wider = width[small] << _16
            width[small] = wider
            small = small[wider < _LEAST]


def _rounds(steps: int) -> Iterator[tuple[int, int]]:
    """The first and last steps of the rounds: 1, 1, 2, 4, ... steps."""
    start = 0
    while start < steps:
        end = min(steps, start + min(ROUND, max(1, start)))
        yield start, end
        start = end


def _lanes(ids: int) -> tuple[int, int, int]:
    """How many lanes so many ids make, the steps that all lanes take, and the lanes that take one more."""
    lanes = max(1, min(LANES, ids // LANE_IDS))
    return lanes, *divmod(ids, lanes)


def _steps(symbols: np.ndarray, sentinel: int) -> np.ndarray:
    """A row for each step, with the symbol of each lane, below two rows of the sentinel."""
    lanes, steps, more = _lanes(len(symbols))
    table = np.full((steps + 3, lanes), sentinel, np.int64)
    cut = more * (steps + 1)
    _turn(symbols[:cut].reshape(more, steps + 1), table[2:, :more])
    _turn(symbols[cut:].reshape(lanes - more, steps), table[2:-1, more:])
    return table


def _unsteps(table: np.ndarray, ids: int) -> np.ndarray:
    lanes, steps, more = _lanes(ids)
    symbols, cut = np.empty(ids, table.dtype), more * (steps + 1)
    _turn(table[2:, :more], symbols[:cut].reshape(more, steps + 1))
    _turn(table[2:-1, more:], symbols[cut:].reshape(lanes - more, steps))
    return symbols


def _turn(table: np.ndarray, into: np.ndarray) -> None:
    """Transpose a table, in blocks that fit into the cache."""
    for i in range(0, len(table), 64):
        for j in range(0, table.shape[1], 64):
            into[j : j + 64, i : i + 64] = table[i : i + 64, j : j + 64].T


def _words(ids: int, bits: int) -> int:
    """The most words that a lane can have."""
    return (ids // _lanes(ids)[0] + 1) * (bits + 1) // 16 + 8


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in ascending order, and each id's place among them."""
    top = int(ids.max())
    if top > 4 * len(ids) + 1_000_000:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(top + 1, np.int64)
    there[ids] = 1
    alphabet = np.flatnonzero(there)
    there[alphabet] = np.arange(len(alphabet))
    return alphabet, there.take(ids)


def write_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The alphabet of a block of ids, how many words of 16 bits each lane has, and the words."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), b""
    alphabet, symbols = _alphabet(ids)
    lanes, steps, more = _lanes(len(ids))
    model = _Model(len(alphabet), len(ids))
    shift, bits = np.uint64(model.bits), np.uint64(model.bits + _CHANCE)
    coder, table = _Writer(lanes, _words(len(ids), int(bits))), _steps(symbols, len(alphabet))

    def code(first: int, last: int, n: int) -> tuple:
        s2, s1, symbol = (table[first + i : last + i, :n] for i in range(3))
        context, e1, e2, guess, kind, chance = model.predict(s1, s2)
        right = (guess == symbol) & (chance > 0)
        hit, miss = chance << shift, _ONE - chance
        start = np.where(right, 0, hit + miss * model.start.take(symbol))
        share = np.where(right, hit, miss * model.share.take(symbol))
        for a, b in zip(start, share, strict=True):
            coder.code(a, b, bits)
        return s1, context, e1, e2, kind, right, symbol

    for first, last in _rounds(steps):
        model.learn(*[x.ravel() for x in code(first, last, lanes)])
    if more:
        code(steps, steps + 1, more)
    return alphabet, *coder.finish()


def read_block(alphabet: np.ndarray, sizes: np.ndarray, data: bytes, count: int) -> np.ndarray:
    """The ``count`` ids of a block."""
    if not count:
        return np.zeros(0, np.int64)
    lanes, steps, more = _lanes(count)
    model = _Model(len(alphabet), count)
    shift, bits = np.uint64(model.bits), np.uint64(model.bits + _CHANCE)
    coder = _Reader(sizes, data, _words(count, int(bits)))
    table = np.full((steps + 3, lanes), len(alphabet), np.int64)

    def step(t: int, n: int) -> tuple:
        context, e1, e2, guess, kind, chance = model.predict(table[t + 1, :n], table[t, :n])
        target, hit, miss = coder.target(n, bits), chance << shift, _ONE - chance
        right = target < hit
        place = np.where(right, 0, target - hit) // miss
        symbol = np.where(right, guess, model.found.take(place.view(np.int64)))
        start = np.where(right, 0, hit + miss * model.start.take(symbol))
        coder.code(start, np.where(right, hit, miss * model.share.take(symbol)))
        table[t + 2, :n] = symbol
        return context, e1, e2, kind, right

    for first, last in _rounds(steps):
        came = (np.concatenate(x) for x in zip(*[step(t, lanes) for t in range(first, last)], strict=True))
        model.learn(table[first + 1 : last + 1].ravel(), *came, table[first + 2 : last + 2].ravel())
    if more:
        step(steps, more)
    return alphabet[_unsteps(table, count)]


def pack(lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment: texts' lengths, the words of each lane, the alphabet, then the words."""
    alphabet, sizes, words = write_block(ids)
    letters = zlib.compress(np.diff(alphabet, prepend=0).astype("<u4").tobytes())
    index = np.array([*lengths, *sizes.tolist()], "<u4").tobytes()
    return _HEAD.pack(_MAGIC, len(lengths), len(sizes), len(letters), zlib.crc32(ids.astype("<u4").tobytes())) + index + letters + words


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lengths and all ids of a segment; raises if it is damaged."""
    magic, n_texts, n_lanes, n_letters, wanted = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("no segment of token ids")
    index = np.frombuffer(data, "<u4", n_texts + n_lanes, _HEAD.size).astype(np.int64)
    lengths, sizes = index[:n_texts], index[n_texts:]
    at = _HEAD.size + 4 * len(index)
    try:
        alphabet = np.cumsum(np.frombuffer(zlib.decompress(data[at : at + n_letters]), "<u4").astype(np.int64))
    except zlib.error as e:
        raise ValueError("the alphabet is damaged") from e
    ids = read_block(alphabet, sizes, data[at + n_letters :], int(lengths.sum()))
    if zlib.crc32(ids.astype("<u4").tobytes()) != wanted:
        raise ValueError("the block is damaged")
    return lengths, ids


def write_ids(df: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode all texts, add ``end_id`` to each, and write the segments in ascending order of ids."""
    data = broadcast_file(df.sparkSession, vocabulary)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(c(id_col).alias("id"), F.coalesce(c(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, c("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            packed = pack([len(x) // 4 for x in texts], np.frombuffer(b"".join(texts), "<u4").astype(np.int64))
            values = [[part], [segment], [size], [ids], [packed]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(batch.schema.field(0).type), pa.binary()]
            for own_ids, own in ([x.to_pylist() for x in part.columns] for part in slices(batch)):
                for i, x in zip(own_ids, load(data.value).packed(own), strict=True):
                    x += end
                    if texts and size + len(x) // 4 > SEGMENT:
                        yield row()
                        segment, ids, texts, size = segment + 1, [], [], 0
                    ids.append(i)
                    texts.append(x)
                    size += len(x) // 4
        if texts:
            yield row()

    names = ["part", "segment", "n_ids", "ids", "data"]
    schema = f"part int, segment int, n_ids long, ids array<{id_type(df, id_col)}>, data binary"
    rows.mapInArrow(run, schema).write.parquet(path)


def read_ids(spark, path: str, id_name: str = "doc_id") -> DataFrame:
    """Each text of the files: its place in the order of ids, its number of ids with the end id, and their checksum."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition
    starts, total = [], 0
    for r in totals:
        starts.append((r.part, total))
        total += r.n
    first = spark.createDataFrame(starts, "part int, part_start long")
    order = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("part", "segment", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    places = places.join(F.broadcast(first), "part").select("part", "segment", (F.col("before") + F.col("part_start")).alias("start"))
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def work(ids, packed, starts):
        out = [[], [], [], []]
        for own, data, start in zip(ids, packed, starts, strict=True):
            lengths, values = unpack(data)
            ends = np.cumsum(lengths)
            raw = values.astype("<u4").tobytes()
            out[0] += own
            out[1] += (start + ends - lengths).tolist()
            out[2] += lengths.tolist()
            out[3] += [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return out

    schema = f"`{id_name}` {kind}, start long, n_tokens long, ids_crc32 long"
    return map_columns(files.join(places, ["part", "segment"]), ["ids", "data", "start"], schema, work)
