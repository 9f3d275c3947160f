"""Byte-level BPE encoding and decoding of distinct words with higher-order functions.

Texts are cut into words by the tokenizer's pattern.  Each distinct word of the corpus is encoded once, by Spark: its bytes are an array of byte ids,
and a fold merges the leftmost pair of the lowest rank until no pair has one.  The rank map is a literal (a
scalar subquery over one row) from pairs of ids to the id of what they join to; decoding concatenates the binary
pieces of the ids.  Texts then look their words up, so no word's occurrence is ever shuffled: the table of distinct
words is counted first and sent to the executors if it has at most ``BROADCAST_WORDS`` words.  Beyond it the table has the words
that the most tasks met.  The others, most of which a single task met, go through the same merges in the tasks that meet them: no larger corpus has a larger
table, and neither texts nor occurrences are moved.

A word of more than ``LONG_WORD`` bytes (unspaced texts, encoded data) would take a fold of quadratic cost; such words merge with a
heap instead, which finds the same pairs in the same order.

A null text counts as empty and has no tokens.  Rows are encoded one by one; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from array import array
from collections import ChainMap
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm.common import id_type, map_columns, slices
from tidemill.llm.units import cut
from tidemill.session import stage

#: Bytes of a word from which on it is merged with a heap.
LONG_WORD = 256
#: Words whose ids are sent to the executors, about 25 bytes each.
BROADCAST_WORDS = 2_000_000
#: Pieces of texts that a Python worker keeps.
_CACHED = 1_000_000
#: Bytes of the packed table that the driver holds at once, and sends as one variable.
_SENT_BYTES = 16_000_000
_END = 1 << 20  # stands before and after a word; larger than any id
_ALL = 1 << 30
_NO_RANK = 1 << 30
_MODULI = (131_071, 139_969, 146_077, 155_921)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with lines of a base64 piece and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literals(spark, ranks: dict[bytes, int]) -> tuple[DataFrame, int]:
    """One row: ``ranks``, buckets of maps from a pair of ids to the joined id; ``bytes``, the ids of single bytes; ``pieces``."""
    keys, values = array("q"), array("i")
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                keys.append(a * _END + b)
                values.append(rank)
    key, value = np.frombuffer(keys, np.int64) if keys else np.zeros(0, np.int64), np.frombuffer(values, np.int32) if values else np.zeros(0, np.int32)
    modulus = min(_MODULI, key=lambda m: np.bincount(key % m, minlength=1).max())
    order = np.argsort(key % modulus, kind="stable")
    buckets = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(key % modulus, minlength=modulus))]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(key[order]), pa.array(value[order])], names=["key", "value"]),
    )
    pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    columns = [one(buckets), one(pa.array([ranks[bytes([x])] for x in range(256)], pa.int32())), one(pa.array(pieces, pa.binary()))]
    # Stored first: the driver would else turn a local row's buckets into maps by itself, once for each literal.
    row = stage(spark.createDataFrame(pa.Table.from_arrays(columns, names=["ranks", "bytes", "pieces"])), "bpe-literals")
    return row.select(F.transform("ranks", F.map_from_entries).alias("ranks"), "bytes", "pieces"), modulus


def _encode_word(word: Column, ranks: Column, byte_ids: Column, modulus: int) -> Column:
    def joined(a: Column, b: Column) -> Column:
        key = a.cast("long") * _END + b
        return F.element_at(F.get(ranks, (key % modulus).cast("int")), key)

    def start(ids: Column) -> Column:
        return F.struct(ids.alias("ids"), F.zip_with(ids, F.slice(ids, 2, _ALL), joined).alias("next"))

    def merge(state: Column, _: Column) -> Column:
        ids, following = state["ids"], state["next"]

        def at(low: Column) -> Column:
            new, i = F.shiftright(low, 32).cast("int"), low.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
            return F.struct(
                F.flatten(F.array(F.slice(ids, F.lit(1), i), F.array(new), F.slice(ids, i + 3, F.lit(_ALL)))).alias("ids"),
                F.flatten(
                    F.array(
                        F.slice(following, F.lit(1), i - 1),
                        F.array(joined(F.get(ids, i - 1), new), joined(new, F.get(ids, i + 2))),
                        F.slice(following, i + 3, F.lit(_ALL)),
                    )
                ).alias("next"),
            )

        # The lowest rank and, below it, the place of its first pair, as one number: array_position is slow.
        lowest = F.array_min(F.transform(following, lambda rank, i: F.shiftleft(rank.cast("long"), 32) + i))
        # Without a pair the rest of the steps has nothing to look at.
        done = F.struct(ids.alias("ids"), F.slice(following, F.lit(1), F.lit(0)).alias("next"))
        return _bind(lowest, lambda low: F.when(low.isNull(), done).otherwise(at(low)))

    end = F.array(F.lit(_END - 1))
    chars = F.split(F.decode(word, "ISO-8859-1"), "")
    ids = F.concat(end, F.transform(chars, lambda x: F.get(byte_ids, F.ascii(x))), end)
    finish = lambda state: F.slice(state["ids"], F.lit(2), F.size(state["ids"]) - 2)
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), _bind(ids, start), merge, finish)


def _decode_ids(ids: Column, pieces: Column) -> Column:
    return F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.get(pieces, i)))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges over lists, which a word of a few bytes goes through faster than through a heap."""
    if len(word) > LONG_WORD:
        return merge_long(word, ranks)
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    following = [get(word[i : i + 2], _NO_RANK) for i in range(len(word) - 1)]
    while following and (low := min(following)) < _NO_RANK:
        i = following.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del following[i]
        if i < len(following):
            following[i] = get(parts[i] + parts[i + 1], _NO_RANK)
        if i:
            following[i - 1] = get(parts[i - 1] + parts[i], _NO_RANK)
    return [ranks[x] for x in parts]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs: by rank, then from the left."""
    size = len(word)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    ends = list(range(1, size + 1))  # a piece is word[i : ends[i]]; 0 marks pieces that were joined to their left
    heap = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < size and (rank := ranks.get(word[i : ends[after[i]]])) is not None:
            heapq.heappush(heap, (rank, i, ends[after[i]]))

    for i in range(size):
        push(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not ends[i] or j >= size or ends[j] != end:
            continue
        ends[i], after[i], ends[j] = end, after[j], 0
        if after[i] < size:
            before[after[i]] = i
        push(before[i])
        push(i)
    return [ranks[word[i : ends[i]]] for i in range(size) if ends[i]]


def _encode_long(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    # As bounded as the vocabulary.
    known = words.sparkSession.sparkContext.broadcast(ranks)
    pieces: dict[int, bytes] = {}

    def work(words):
        if not pieces:
            pieces.update({rank: piece for piece, rank in known.value.items()})
        ids = [merge_long(w, known.value) for w in words]
        return [words, ids, [b"".join(map(pieces.__getitem__, x)) for x in ids]]

    found = map_columns(words, ["word"], "word binary, ids array<int>, decoded binary", work)
    return found.select("word", F.struct("ids", "decoded").alias("x"))


def encode_words(words: DataFrame, ranks: dict[bytes, int], long_word: int = LONG_WORD) -> DataFrame:
    """``word`` (binary, not empty) with ``x``: its ``ids`` and ``decoded``, the binary that the ids stand for."""
    table, modulus = _literals(words.sparkSession, ranks)
    # The literals are used in one expression, in the projection that adds them, so Spark never copies them into a row.
    rows = words.withColumns({f"_{n}": table.select(n).scalar() for n in ("ranks", "bytes", "pieces")})

    def both(t: Column) -> Column:
        ids = _encode_word(F.col("word"), t["r"], t["b"], modulus)
        return _bind(ids, lambda x: F.struct(x.alias("ids"), _decode_ids(x, t["p"]).alias("decoded")))

    literals = F.struct(c("_ranks").alias("r"), c("_bytes").alias("b"), c("_pieces").alias("p"))
    folded = stage(rows.select("word", F.when(F.octet_length("word") <= long_word, _bind(literals, both)).alias("x")), "bpe-words")
    return folded.where("x IS NOT NULL").unionByName(stage(_encode_long(folded.where("x IS NULL"), ranks), "bpe-long-words"))


def distinct_words(df: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """The distinct words (binary) of all texts, and how many times (``n``) a task met each for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        units: set[str] = set()
        words: set[str] = set()
        for batch in batches:
            for texts in (part.column(0).to_pylist() for part in slices(batch)):
                new_units = set(chain.from_iterable(map(cut, filter(None, texts)))).difference(units)
                new = set(chain.from_iterable(map(find, new_units))).difference(words)
                yield pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "replace") for w in new], pa.binary())], names=["word"])
                if len(units) > 1_000_000:  # only saves work: the words are made distinct after this
                    units, words = set(), set()
                units |= new_units
                words |= new

    return _dealt(df.select(c(text_col)).mapInArrow(run, "word binary")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _dealt(words: DataFrame) -> DataFrame:
    # An explicit number of partitions, as encoding costs far more than the bytes of the words suggest.
    return words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")


def table_words(words: DataFrame, limit: int, key: Column | None = None) -> DataFrame:
    """Of the words and their ``n``: all, or at most ``limit`` that the most tasks met, without words that share their hash with another."""
    met = sorted(((r["n"], r["words"]) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    held, least = 0, None
    for n, k in met:  # as many rows as there are tasks, at most
        if (held := held + k) > limit:
            break
        least = n
    if least is None:
        return words.where(F.lit(False)).select("word")
    key = F.xxhash64("word") if key is None else key
    chosen = words.where(F.col("n") >= least)
    if sum(k for _, k in met) != words.agg(F.count_distinct(key)).first()[0]:
        chosen = chosen.withColumn("h", key).join(words.groupBy(key.alias("h")).count().where("count > 1"), "h", "left_anti")
    return chosen.select("word")


class _Table:
    """Packed entries of some words, found by the hash of the word: about 20 bytes each."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        ends = np.cumsum(sizes, dtype=np.int64)
        self.starts, self.sizes = (ends - sizes).astype(np.uint32 if len(ids) < 2**32 else np.int64)[order], sizes[order]
        self.ids = ids

    def fill(self, keys: np.ndarray, rest: np.ndarray, out: list[str]) -> np.ndarray:
        """Sets the ids, as decimals joined by commas, of those of the keys ``rest`` that are here; returns the others."""
        at = np.minimum(np.searchsorted(self.hashes, keys[rest]), len(self.hashes) - 1)
        here = self.hashes[at] == keys[rest]
        starts, sizes = self.starts[at[here]].astype(np.int64), self.sizes[at[here]]
        ends = np.cumsum(sizes, dtype=np.int64)
        # The ids of all words in a row.
        ids = list(map(str, self.ids[np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)].tolist()))
        start = 0
        for i, end in zip(rest[here].tolist(), ends.tolist(), strict=True):
            out[i] = ",".join(ids[start:end])
            start = end
        return rest[~here]


def _find(tables: list[_Table], odd: dict[bytes, bytes], words: list[bytes]) -> list[tuple[str, bytes]]:
    """The ids of each word and its decoded bytes."""
    return [(x, odd.get(w, w)) for x, w in zip(_find_ids(tables, words), words, strict=True)]


def _find_ids(tables: list[_Table], words: list[bytes], merge: Callable[[bytes], str] | None = None) -> list[str]:
    """The ids of each word; ``merge`` finds those of words that are in no table."""
    keys = _hashes(words)
    # In order, so that the search stays in one place of a table.
    out, rest = [""] * len(words), np.argsort(keys)
    for table in tables:
        rest = table.fill(keys, rest, out)
    if len(rest) and merge is None:
        raise LookupError("a word is not in the table")
    for i in rest.tolist():
        out[i] = merge(words[i])
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 of binary values."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


class _Known(dict):
    """What is known of pieces of texts; those that were asked for in vain are kept in ``asked``."""

    def __init__(self) -> None:
        super().__init__()
        self.asked: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.asked.append(piece)


class _Merges:
    """Encodes and decodes words that are in no table; ``odd`` gets those that decode to other bytes."""

    def __init__(self, ranks: dict[bytes, int], odd: dict[bytes, bytes]) -> None:
        self.ranks, self.pieces = ranks, {rank: piece for piece, rank in ranks.items()}
        self.known, self.odd = odd, ChainMap({}, odd)

    def forget(self) -> None:
        """What was found to be odd is known by its pieces from then on."""
        if self.odd.maps[0]:
            self.odd = ChainMap({}, self.known)

    def __call__(self, word: bytes) -> str:
        ids = merge_word(word, self.ranks)
        if (decoded := b"".join(map(self.pieces.__getitem__, ids))) != word:
            self.odd[word] = decoded
        return ",".join(map(str, ids))


_UNITS: dict[str, tuple[_Known, dict[str, bytes], _Merges]] = {}


def encode_texts(
    df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS
) -> DataFrame:
    """Number of tokens of each row, and digests of its ids and of what they decode to."""
    ranks = read_ranks(vocabulary)
    words = stage(distinct_words(df, text_col, pattern), "bpe-distinct-words")
    sent, odd = _sent(encode_words(_dealt(table_words(words, broadcast_words)), ranks).select("word", "x.ids", "x.decoded"))
    known = df.sparkSession.sparkContext.broadcast(ranks)  # as bounded as the vocabulary
    kind = id_type(df, id_col)
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = df.select(c(id_col).alias("id"), c(text_col).alias("text"))
    cache_name = uuid.uuid4().hex

    def work(ids, texts):
        if cache_name not in _UNITS:  # a worker keeps the pieces of one query only
            _UNITS.clear()
            _UNITS[cache_name] = (_Known(), {}, _Merges(known.value, odd.value))
        ids_of, odd_of, merges = _UNITS[cache_name]
        merges.forget()
        tables = [x.value for x in sent]
        return [ids, *_digests(texts, pattern, lambda words: _find_ids(tables, words, merges), merges.odd, (ids_of, odd_of))]

    return map_columns(rows, ["id", "text"], schema, work)


def _sent(encoded: DataFrame) -> tuple[list[Broadcast], Broadcast]:
    """The whole table, which is known to be small enough, packed by the executors and sent back to them in parts.

    The driver never holds more than about ``_SENT_BYTES`` of it; each part is sorted by itself.
    """
    context = encoded.sparkSession.sparkContext
    odd = {bytes(r.word): bytes(r.decoded) for r in encoded.where("decoded <> word").select("word", "decoded").collect()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            narrow = np.uint16 if flat.max(initial=0) < 65_536 else np.int32
            sizes = np.diff(ids.offsets.to_numpy())
            row = [[batch.column(0).to_numpy().tobytes()], [sizes.astype(np.int32).tobytes()], [flat.astype(narrow).tobytes()], [narrow is np.uint16]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["hashes", "sizes", "ids", "narrow"])

    packed = encoded.select(F.xxhash64("word").alias("h"), "ids").mapInArrow(pack, "hashes binary, sizes binary, ids binary, narrow boolean")
    sent, parts, held = [], [], 0
    for r in packed.toLocalIterator():  # a partition at a time
        parts.append((r.hashes, r.sizes, r.ids, r.narrow))
        held += len(r.hashes) + len(r.sizes) + len(r.ids)
        if held > _SENT_BYTES:
            sent.append(context.broadcast(_table(parts)))
            parts, held = [], 0
    if parts:
        sent.append(context.broadcast(_table(parts)))
    return sent, context.broadcast(odd)


def _table(parts: list[tuple[bytes, bytes, bytes, bool]]) -> _Table:
    hashes = np.concatenate([np.frombuffer(h, np.int64) for h, _, _, _ in parts])
    sizes = np.concatenate([np.frombuffer(n, np.int32) for _, n, _, _ in parts])
    return _Table(hashes, sizes, np.concatenate([np.frombuffer(x, np.uint16 if narrow else np.int32) for _, _, x, narrow in parts]))


def _digests(texts: list[str | None], pattern: str, find, odd: dict[bytes, bytes], cache: tuple[_Known, dict[str, bytes]]) -> list[list]:
    """Counts and digests; ``odd`` has the words that decode to other bytes than their own.

    ``cache`` has the ids (as text) of pieces of texts, and the decoded bytes where they aren't those of the piece.
    """
    ids_of, odd_of = cache
    units = [cut(t) if t else [] for t in texts]
    known = [list(map(ids_of.__getitem__, own)) for own in units]
    if ids_of.asked:
        new = list(set(ids_of.asked))
        ids_of.asked.clear()
        _learn(new, pattern, find, odd, cache)
        for own, ids in zip(units, known, strict=True):
            i = -1
            for _ in range(ids.count(None)):
                i = ids.index(None, i + 1)
                ids[i] = ids_of[own[i]]
    counts, ids_digests, decoded_digests = [], [], []
    for text, own, found in zip(texts, units, known, strict=True):
        if odd_of and not odd_of.keys().isdisjoint(own):  # a piece without a token is one of them
            ids = ",".join(filter(None, found)).encode()
            decoded = b"".join([odd_of[u] if u in odd_of else u.encode("utf-8", "replace") for u in own])
        else:  # every piece decodes to its own bytes, and the pieces are the whole text
            ids = ",".join(found).encode()
            decoded = (text or "").encode("utf-8", "replace")
        counts.append(ids.count(b",") + 1 if ids else 0)
        ids_digests.append(hashlib.sha256(ids).hexdigest())
        decoded_digests.append(hashlib.sha256(decoded).hexdigest())
    if len(ids_of) > _CACHED:
        ids_of.clear()
        odd_of.clear()
    return [counts, ids_digests, decoded_digests]


def _learn(new: list[str], pattern: str, find, odd: dict[bytes, bytes], cache: tuple[_Known, dict[str, bytes]]) -> None:
    """Adds pieces of texts to the cache."""
    ids_of, odd_of = cache
    # One list of all words: a list for each piece would have the garbage collector go through the cache again and again.
    split, words, sizes = regex.compile(pattern).findall, [], []
    for unit in new:
        own = split(unit)
        words += own
        sizes.append(len(own))
    flat = list(set(words))
    raw = [w.encode("utf-8", "replace") for w in flat]
    ids_of_word = dict(zip(flat, find(raw), strict=True))
    here = {w: odd[b] for w, b in zip(flat, raw, strict=True) if b in odd} if odd else {}
    start = 0
    for unit, size in zip(new, sizes, strict=True):
        # Words in a row that are as long as the piece are the piece.
        if size == 1:
            ids_of[unit] = ids_of_word[words[start]]
            whole = len(words[start]) == len(unit)
        else:
            own = words[start : start + size]
            ids_of[unit] = ",".join(map(ids_of_word.__getitem__, own))
            whole = sum(map(len, own)) == len(unit)
        if here or not whole:
            decoded = b"".join([here[w] if w in here else w.encode("utf-8", "replace") for w in words[start : start + size]])
            if decoded != unit.encode("utf-8", "replace"):
                odd_of[unit] = decoded
        start += size
