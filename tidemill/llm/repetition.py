"""Quality rules: length, and repetition found with a suffix array over the words of each text.

A slice of texts is one array of word codes.  Prefix doubling ranks all suffixes, where a position leaves the sort
as soon as no other position of its text shares its prefix, so only true repeats are sorted more than a few times.
The common prefix of neighbours in the suffix array gives the longest repeat that starts at each position; the union
of these spans is the covered part of the text.

A null or empty text has no words, fails, and repeats nothing.  Rows are judged one by one, so repeated rows get
repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemill.llm.common import id_type, keep_rows, map_columns

_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")


@dataclass(frozen=True)
class Rules:
    """``min_repeat`` words make a repeat; fractions are of the words of a text."""

    min_words: int = 20
    min_repeat: int = 8
    max_covered_percent: int = 30
    max_longest_percent: int = 20


def repetition(texts: list[str], min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words inside repeats of at least ``min_repeat`` words, and the longest repeat, for each text."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), sizes)[real]
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)[real].astype(np.int64)
    words = np.bincount(doc, minlength=len(texts))
    covered, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if not len(code):
        return words, covered, longest
    end = np.cumsum(words)[doc]
    order, levels = _suffix_order(code, doc, end, min_repeat)
    if len(order):
        reach = _longest_repeats(order, levels, len(code))
        reach[reach < min_repeat] = 0
        starts = np.flatnonzero(reach)
        edges = np.zeros(len(code) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + reach[starts], -1)
        covered = np.bincount(doc, weights=np.cumsum(edges[:-1]) > 0, minlength=len(texts)).astype(np.int64)
        np.maximum.at(longest, doc[starts], reach[starts])
    return words, covered, longest


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key, and whether another position has the same key."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[order][1:], keys[order][:-1], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    rank, shared = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    rank[order] = first
    alone = new & np.append(new[1:], True)
    shared[order] = ~alone
    return rank, shared


def _suffix_order(code, doc, end, min_repeat) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions that start a repeated window, in suffix order, and the ranks of all positions by prefix length.

    A rank is the number of positions in front of its group, so ranks of one length order and identify prefixes;
    a position that is alone keeps its rank for good.  A prefix that the end of its text cuts short has no equal.
    """
    n = len(code)
    rank, shared = _dense(doc * np.int64(code.max() + 1) + code)
    levels, h, starts = [(1, rank)], 1, None
    while True:
        if h >= min_repeat and starts is None:
            starts = np.flatnonzero(_windows_repeat(levels, end, min_repeat, n))
        open_ = np.flatnonzero(shared)
        if not len(open_):
            break
        after = open_ + h
        tail = np.where(after < end[open_], rank[np.minimum(after, n - 1)] + 1, 0)
        local, still = _dense(rank[open_] * np.int64(n + 1) + tail)
        _, group, size = np.unique(rank[open_], return_index=False, return_inverse=True, return_counts=True)
        before = np.concatenate(([0], np.cumsum(size)[:-1]))[group]
        rank = rank.copy()
        rank[open_] += local - before
        shared = np.zeros(n, bool)
        shared[open_] = still
        h *= 2
        levels.append((h, rank))
    if starts is None:
        starts = np.zeros(0, np.int64)
    return starts[np.argsort(rank[starts], kind="stable")], levels


def _windows_repeat(levels, end, length, n) -> np.ndarray:
    """Whether the window of ``length`` words at each position is there twice: two shorter, overlapping ones say so."""
    h, rank = max((x for x in levels if x[0] <= length), key=lambda x: x[0])
    at = np.flatnonzero(np.arange(n) + length <= end)
    found = np.zeros(n, bool)
    found[at] = _dense(rank[at] * np.int64(n + 1) + rank[at + length - h])[1]
    return found


def _longest_repeats(order, levels, n) -> np.ndarray:
    """The longest prefix that each position of ``order`` shares with a neighbour in suffix order."""
    left, right = order[:-1], order[1:]
    common = np.zeros(len(left), np.int64)
    for h, rank in reversed(levels):
        i, j = left + common, right + common
        inside = np.maximum(i, j) < n
        common[inside] += h * (rank[i[inside]] == rank[j[inside]])
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, left, common)
    np.maximum.at(reach, right, common)
    return reach


def _judge(texts: list[str | None], rules: Rules) -> list[list]:
    texts = [t or "" for t in texts]
    words, covered, longest = repetition(texts, rules.min_repeat)
    chars = [len(t) - sum(map(t.count, _SPACES)) for t in texts]
    symbols = [sum(map(t.count, _SYMBOLS)) for t in texts]
    dups = []
    for t in texts:
        lines = [x for x in t.split("\n") if _LINE_WORD.search(x)]
        dups.append(len(lines) - len(set(lines)))
    failed = (words < rules.min_words) | (100 * covered > rules.max_covered_percent * words)
    kept = ~failed & (100 * longest <= rules.max_longest_percent * words)
    columns = [words, chars, symbols, dups, covered, longest, failed, kept]
    return [x.tolist() if isinstance(x, np.ndarray) else x for x in columns]


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Counts and verdict of each row: too short, covered by repeats, or one repeat too long."""
    schema = (
        f"`{id_col}` {id_type(df, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"
    )
    return map_columns(df, [id_col, text_col], schema, lambda ids, texts: [ids, *_judge(texts, rules)])


def keep_good(df: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows that pass, with all their columns."""
    return keep_rows(df, text_col, lambda texts: _judge(texts, rules)[-1])
