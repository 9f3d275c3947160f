"""Benchmark decontamination by Wu-Manber search over words.

Windows of the same length form one search.  A shift table over blocks of two words says how far the window can move
when a block ends no test string; where the shift is zero, the block's bucket lists the test strings with that suffix,
by their first block, and comparing the words confirms an occurrence.

Words are runs of letters and digits, lower-cased in ASCII; bytes from 0x80 count as letters.  A null or empty text has
no words; an item without words has no window.  Items with one id are one item, and a null id is written as an empty
text.  The test strings are worked off in blocks of at most about ``BLOCK_WORDS`` words, so what is sent to the
executors stays bounded however large the benchmark is.  Rows are searched one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm.common import id_type, keep_rows, map_columns
from tidemill.session import stage

#: Words of benchmark text whose tables are sent at once (about 300 bytes each with their windows).
BLOCK_WORDS = 500_000

#: Bytes that are part of words keep their (lower-case) value, all others become spaces.
_TABLE = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Search:
    """Test strings of one length."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[list[bytes], set[str]]]]] = defaultdict(lambda: defaultdict(list))
        self.known: dict[tuple, set[str]] = {}

    def add(self, string: tuple, item: str) -> None:
        if string in self.known:
            self.known[string].add(item)
            return
        self.known[string] = items = {item}
        for last in range(self.block, self.length + 1):
            key = string[last - self.block : last]
            self.shift[key] = min(self.shift.get(key, self.length), self.length - last)
        self.buckets[string[-self.block :]][string[: self.block]].append((list(string), items))

    def find(self, words: list[bytes]):
        """Start and items of every occurrence."""
        length, block, shift, buckets = self.length, self.block, self.shift, self.buckets
        far = length - block + 1
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            move = shift.get(key, far)
            if not move:
                start = end - length
                for string, items in buckets[key].get(tuple(words[start : start + block]), ()):
                    if words[start:end] == string:
                        yield start, items
                move = 1
            end += move


def _searches(items: list[tuple[str, str | None]], window: int) -> list[Search]:
    found: dict[int, Search] = {}
    for item, text in items:
        words = _split(text)
        size = min(window, len(words))
        if size:
            search = found.setdefault(size, Search(size))
            for i in range(len(words) - size + 1):
                search.add(tuple(words[i : i + size]), item)
    for search in found.values():
        search.known = {}
        search.buckets = {k: dict(v) for k, v in search.buckets.items()}
    return list(found.values())


def _scan(words: list[bytes], searches: list[Search]) -> tuple[list[int], set[str]]:
    """Positions of hit words as flat pairs of start and end, disjoint and ascending, and the items found."""
    spans, items = [], set()
    for search in searches:
        for start, found in search.find(words):
            spans.append((start, start + search.length))
            items |= found
    return _union(spans), items


def _union(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _blocks(bench: DataFrame, id_col: str, text_col: str, window: int) -> list:
    """The search tables of each block, broadcast."""
    spark = bench.sparkSession
    rows = bench.select(F.coalesce(c(id_col).cast("string"), F.lit("")).alias("item"), c(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / 6 / BLOCK_WORDS))
    parts = [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) for k in range(count)]
    return [spark.sparkContext.broadcast(_searches([(r.item, r.text) for r in part.collect()], window)) for part in parts]


def find_leaks(
    df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10,
) -> DataFrame:
    """Words, hit words and items of each row; an item of fewer words than ``window`` is one window."""
    blocks = _blocks(bench, item_col, item_text_col, window)
    state = df.select(c(id_col).alias("id"), c(text_col).alias("text"), F.expr("CAST(NULL AS array<int>)").alias("spans"), F.expr("CAST(NULL AS array<string>)").alias("items"))
    kind = id_type(df, id_col)
    for k, tables in enumerate(blocks):
        if k < len(blocks) - 1:  # with several blocks, what is found so far goes along with the text
            schema = f"id {kind}, text string, spans array<int>, items array<string>"
            state = stage(map_columns(state, ["id", "text", "spans", "items"], schema, lambda *x, t=tables: _add(t.value, *x)), "leaks")
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return map_columns(state, ["id", "text", "spans", "items"], schema, lambda *x, t=blocks[-1]: _sum(*_add(t.value, *x)))


def drop_leaks(df: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows without a hit word, with all their columns."""
    for tables in _blocks(bench, item_col, item_text_col, window):
        df = keep_rows(df, text_col, lambda texts, t=tables: [not any(True for s in t.value for _ in s.find(_split(x))) for x in texts])
    return df


def _add(searches, ids, texts, spans, items) -> list[list]:
    out_spans, out_items = [], []
    for text, old, known in zip(texts, spans, items, strict=True):
        new, found = _scan(_split(text), searches)
        old = old or []
        out_spans.append(_union([*zip(old[::2], old[1::2]), *zip(new[::2], new[1::2])]))
        out_items.append(sorted(found.union(known or ())))
    return [ids, texts, out_spans, out_items]


def _sum(ids, texts, spans, items) -> list[list]:
    hits = [sum(s[1::2]) - sum(s[::2]) for s in spans]
    digests = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
    return [ids, [len(_split(t)) for t in texts], hits, [len(i) for i in items], digests, [h > 0 for h in hits]]
