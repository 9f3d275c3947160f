"""Grouping of spelling variants: generated edits, Bloom filters of the vocabulary, and an exact join.

Words and their counts form the vocabulary, which is stored.  Two words are near if they differ by one inserted, deleted or replaced
character.  A pair is looked for from one side only: deletions are generated from its longer word, replacements
from the word with the smaller character.  Words and edits have the same 64-bit polynomial hash, so an edit's hash
follows from its word's in a few operations, and millions are probed at once against a Bloom filter of the vocabulary.

The filter is sharded by word length and blocked: a word sets its bits in one block of 64.  Shards are built in
segments of bounded size, each by one task, and are sent to the executors in rounds of at most ``max_bytes``; so
a vocabulary of any size costs more rounds, never a larger broadcast.  Only edits that the filter doesn't rule out become
rows, which an exact join with the vocabulary reduces to true pairs.  Long words, of which each wrong row
would cost much, have larger filters.

The form of a word is its near word with the largest count (the smallest of equals) if that has ``ratio`` times its own count.
Forms of forms are followed by doubling, so the number of rounds is the logarithm of the longest chain.

Null texts have no words; a null id counts as an empty one.  Repeated rows count again.  An empty table gives no words; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm.common import slices
from tidemill.session import stage

#: Blocks of 64 bits of a filter segment.
SEGMENT = 1 << 12
#: Edits that are probed at once.
_PROBES = 1 << 20
_LONG = 32  # characters; longer words have larger filters
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_32, _LOW6, _ONE = np.uint64(32), np.uint64(63), np.uint64(1)


@dataclass(frozen=True)
class Spelling:
    """``letters`` is a class of a regular expression; one run in ``misspelt`` loses a character (0: none does)."""

    letters: str = "A-Za-zÀ-ÿ"
    min_length: int = 6
    min_count: int = 5
    misspelt: int = 0
    ratio: int = 5
    max_bytes: int = 256 << 20


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Spelling = Spelling()) -> DataFrame:
    """``word`` and ``n``: maximal runs of letters with A to Z in lower case, long and common enough.

    With ``misspelt``, a run whose checksum with its row's id it divides loses the character that the checksum points to.
    """
    # A run that is shorter than the words never becomes one.
    found = F.regexp_extract_all(c(text_col), F.lit(f"([{rule.letters}]{{{rule.min_length},}})"), F.lit(1))
    runs = df.select(c(id_col).cast("string").alias("id"), F.explode(found).alias("run"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, lower)).otherwise(F.col("run")).alias("run"))
    word: Column = F.col("run")
    if rule.misspelt:
        check = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")))
        runs = runs.select("run", check.alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % rule.misspelt == 0, shorter).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= rule.min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rule.min_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _code(points: np.ndarray) -> np.ndarray:
    """A random-looking number for each code point."""
    return _mixed(points.astype(np.uint64) * _BASE + _ONE)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_ONE], np.full(n, _BASE, np.uint64)]))


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)


def _sums(points: np.ndarray) -> np.ndarray:
    """Hashes of each word's beginnings: one column more than the word has characters."""
    terms = _code(points) * _powers(points.shape[1])[:-1]
    return np.concatenate([np.zeros((len(points), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)


@dataclass(frozen=True)
class Shard:
    """The filter of the words of one length: its number of blocks, and the ones that are here."""

    blocks: int
    probes: int  # bits of a word
    first: int = 0
    bits: np.ndarray | None = None

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash, and a number whose digits say which bits."""
        x = _mixed(hashes)
        block = ((x >> _32) * np.uint64(self.blocks)) >> _32
        return block.astype(np.int64), x * _MIX[1]

    def mask(self, digits: np.ndarray) -> np.ndarray:
        out = np.zeros(len(digits), np.uint64)
        for k in range(self.probes):
            out |= _ONE << ((digits >> np.uint64(6 * k)) & _LOW6)
        return out

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """False: no word has this hash, or its block is not here."""
        block, digits = self.place(hashes)
        here = (block >= self.first) & (block < self.first + len(self.bits))
        found = self.bits[np.where(here, block - self.first, 0)]
        hit = here
        for k in range(self.probes):
            hit = hit & ((found >> ((digits >> np.uint64(6 * k)) & _LOW6)) & _ONE).astype(bool)
        return hit


def empty_shard(length: int, words: int) -> Shard:
    """About 16 bits a word and 4 of them set; for long words 512 and 8."""
    return Shard(-(-words // 4), 4) if length <= _LONG else Shard(8 * words, 8)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def build(vocabulary: DataFrame, shards: dict[int, Shard]) -> DataFrame:
    """``length``, ``segment`` and its ``bits``: a task builds whole segments, of about sixteen thousand words."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            words = batch.column(0).to_pylist()
            for size, rows in _by_length(words):
                block, digits = shards[size].place(_sums(_points([words[i] for i in rows.tolist()], size))[:, -1])
                columns = [np.full(len(rows), size), block // SEGMENT, block % SEGMENT, shards[size].mask(digits).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["length", "segment", "block", "mask"])

    def gather(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        length, segment = (x.as_py() for x in key)
        bits = np.zeros(min(SEGMENT, shards[length].blocks - segment * SEGMENT), np.uint64)
        np.bitwise_or.at(bits, rows["block"].to_numpy(), rows["mask"].to_numpy().view(np.uint64))
        return pa.table({"length": pa.array([length], pa.int64()), "segment": pa.array([segment], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    placed = vocabulary.select("word").mapInArrow(place, "length long, segment long, block long, mask long")
    return placed.groupBy("length", "segment").applyInArrow(gather, "length long, segment long, bits binary")


def rounds(shards: dict[int, Shard], max_bytes: int) -> list[list[tuple[int, int, int]]]:
    """Runs of segments (length, first, end) that are sent together."""
    most = max(1, max_bytes // (8 * SEGMENT))
    out: list[list[tuple[int, int, int]]] = [[]]
    room = most
    for length in sorted(shards):
        start, end = 0, -(-shards[length].blocks // SEGMENT)
        while start < end:
            take = min(room, end - start)
            out[-1].append((length, start, start + take))
            start, room = start + take, room - take
            if not room:
                out.append([])
                room = most
    return [x for x in out if x]


def edits(words: list[str], filters: dict[int, Shard], alphabet: np.ndarray) -> Iterator[tuple[int, str]]:
    """The words' places, with each deletion, and each replacement by a larger character, that the filters don't rule out."""
    codes = _code(alphabet)
    for size, rows in _by_length(words):
        same, shorter = filters.get(size), filters.get(size - 1)
        if same is None and shorter is None:
            continue
        step = max(1, _PROBES // max(len(alphabet), size))
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            own = [words[i] for i in part.tolist()]
            points = _points(own, size)
            sums = _sums(points)
            whole = sums[:, -1]
            if shorter is not None:
                hashes = sums[:, :-1] + (whole[:, None] - sums[:, 1:]) * _BACK
                last = np.ones(points.shape, bool)  # equal neighbours give equal words
                last[:, :-1] = points[:, 1:] != points[:, :-1]
                for r, i in zip(*(x.tolist() for x in np.nonzero(last & shorter.has(hashes.ravel()).reshape(hashes.shape))), strict=True):
                    yield int(part[r]), own[r][:i] + own[r][i + 1 :]
            if same is not None:
                own_codes, powers = _code(points), _powers(size)
                for i in range(size):
                    larger = np.nonzero(alphabet[None, :] > points[:, i, None])
                    hashes = whole[larger[0]] + (codes[larger[1]] - own_codes[larger[0], i]) * powers[i]
                    hit = same.has(hashes)
                    for r, a in zip(larger[0][hit].tolist(), alphabet[larger[1][hit]].tolist(), strict=True):
                        yield int(part[r]), own[r][:i] + chr(a) + own[r][i + 1 :]


def candidates(vocabulary: DataFrame, filters, alphabet: np.ndarray) -> DataFrame:
    """``word``, ``n`` and ``other``: edits that may be words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            words, counts = (x.to_pylist() for x in batch.columns)
            rows: list[tuple[int, str]] = []
            size = 0
            for row in edits(words, filters.value, alphabet):
                rows.append(row)
                size += len(row[1])
                if size > _PROBES:
                    yield made(words, counts, rows)
                    rows, size = [], 0
            yield made(words, counts, rows)

    def made(words, counts, rows) -> pa.RecordBatch:
        columns = [[words[i] for i, _ in rows], [counts[i] for i, _ in rows], [x for _, x in rows]]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["word", "n", "other"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, other string")


def near_pairs(vocabulary: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """``word``, ``n``, ``other``, ``n_other``: every pair of near words, once."""
    spark = vocabulary.sparkSession
    held = vocabulary.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    shards = {r["length"]: empty_shard(r["length"], r["n"]) for r in held.collect()}  # one row for each length
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).distinct().where("x <> ''")
    alphabet = np.array(sorted(ord(r["x"]) for r in letters.collect()), np.uint32)  # at most all code points
    segments = stage(build(vocabulary, shards), "filter-segments")
    found = None
    for part in rounds(shards, rule.max_bytes):
        filters: dict[int, Shard] = {}
        for length, first, end in part:
            rows = segments.where((F.col("length") == length) & F.col("segment").between(first, end - 1)).collect()
            here = {r["segment"]: np.frombuffer(r["bits"], np.uint64) for r in rows}
            ends = min(end * SEGMENT, shards[length].blocks)
            bits = np.zeros(ends - first * SEGMENT, np.uint64)
            for segment, own in here.items():
                bits[(segment - first) * SEGMENT :][: len(own)] = own
            filters[length] = Shard(shards[length].blocks, shards[length].probes, first * SEGMENT, bits)
        wanted = sorted({x for length in filters for x in (length, length + 1)})
        rows = vocabulary.where(F.length("word").isin(wanted))
        rows = stage(candidates(rows, spark.sparkContext.broadcast(filters), alphabet), "edits")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "word string, n long, other string")
    return found.join(vocabulary.select(c("word").alias("other"), c("n").alias("n_other")), "other").select("word", "n", "other", "n_other")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: where the forms of forms end.  Counts rise along them, so there are no rings."""
    known = stage(forms.select("word", c("form").alias("root")), "roots")
    while True:
        ahead = known.select(c("word").alias("root"), c("root").alias("next"))
        moved = known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stage(moved, "roots")
        known = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return known


def group(counts: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """Each ``word`` of a table of words and counts ``n``, with ``form``, ``root``, ``n_near`` and ``form_n``."""
    # As many parts as there are cores' worth of probing, however few bytes the words have.
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = stage(counts.select("word", "n").repartition(parts, "word"), "vocabulary")
    pairs = stage(near_pairs(vocabulary, rule), "near-words")
    swapped = pairs.select(c("other").alias("word"), c("n_other").alias("n"), c("word").alias("other"), c("n").alias("n_other"))
    best = F.min(F.struct((-F.col("n_other")).alias("order"), "other")).alias("best")
    near = pairs.unionByName(swapped).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best, F.first("n").alias("n"))
    strong = -F.col("best.order") >= rule.ratio * F.col("n")
    near = stage(near.select("word", "n_near", F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.order")).alias("form_n")), "forms")
    ends = roots(near.where("form IS NOT NULL"))
    out = vocabulary.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
