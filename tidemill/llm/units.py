"""Encoding with a tokenizers file, a cached word at a time.

A byte-level vocabulary splits a text by a pattern before it merges, and always in front of a space that a
visible character follows, and on both sides of a line break between visible characters.  A text cut there has the ids
of its pieces in a row, so the library only has to encode each different piece once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from itertools import chain

import numpy as np

#: White space other than spaces and line breaks, and the mark that :func:`cut` uses.
_RARE = "\x00\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = ("  ", "\n\n", " \n", "\n ")
_CUT = re.compile(r"(?= \S)")
_PLAIN = re.compile(r" ?\S+")
#: Letters whose class no version of Unicode changes, and pieces of which the byte-level pattern's matches are known to be those of ``_MATCH``.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LATIN = re.compile(rf" ?[!-~{_LETTERS}]+")
_MATCH = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_LETTERS}0-9\s]+")
#: The characters that stand for bytes in a byte-level vocabulary: visible ones of Latin-1 for themselves, others from 256 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_VISIBLE)))}
_LINES = 4096
#: Code points of pieces after which the cache starts again.
_CACHE_CHARS = 32_000_000


class Library:
    """A tokenizer of the tokenizers library, made from the bytes of its file."""

    def __init__(self, data: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(data)
        self.cuttable = _cuttable(spec)
        self.spaced = _spaced(spec, self.tokenizer)
        self._ids: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._chars = 0
        if self.cuttable:
            (self._break,) = self.encode(["\n"])[0]
            added = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
            self._added = re.compile("|".join(added)) if added else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, text: str) -> np.ndarray:
        """Start, end (in code points) and id of each token, a row each."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.column_stack([np.array(found.offsets, np.int64).reshape(-1, 2), np.array(found.ids, np.int64)])

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        if self.spaced:
            return self._looked_up([t.replace("\n", " ").split(" ") for t in texts], self._learn_words)
        if not self.cuttable:
            return [np.array(ids, "<u4").tobytes() for ids in self.encode(texts)]
        return self._looked_up([cut(t) for t in texts], self._learn)

    def _looked_up(self, units: list[list[str]], learn) -> list[bytes]:
        """The ids of each list of pieces; ``learn`` is called with the pieces that aren't known."""
        out: list[bytes | None] = []
        known = self._ids.__getitem__
        for own in units:
            try:
                out.append(b"".join(map(known, own)))
            except KeyError:
                out.append(None)
        if missing := [i for i, x in enumerate(out) if x is None]:
            learn(set(chain.from_iterable(units[i] for i in missing)).difference(self._ids))
            for i in missing:
                out[i] = b"".join(map(known, units[i]))
        if self._chars > _CACHE_CHARS:
            self._ids, self._words, self._chars = {}, {}, 0
        return out

    def _learn_words(self, new: set[str]) -> None:
        """Where white space only parts words: pieces between spaces, made of words that are encoded once each."""
        # The strings of special tokens are looked for in the text as it is.
        parts = [[u] if "<|" in u else _INSIDE.split(u.lower() if u.isascii() else u) for u in new]
        unknown = list(set(chain.from_iterable(parts)).difference(self._words))
        tokenize = self.tokenizer.model.tokenize
        other = []
        for w in unknown:
            if w.isascii() and w.isalpha() and w.islower():
                self._words[w] = np.array([x.id for x in tokenize(w)], "<u4").tobytes()
            else:
                other.append(w)
        for w, ids in zip(other, self.encode(other), strict=True):
            self._words[w] = np.array(ids, "<u4").tobytes()
        for unit, own in zip(new, parts, strict=True):
            self._ids[unit] = self._words[own[0]] if len(own) == 1 else b"".join(map(self._words.__getitem__, own))
        self._chars += sum(map(len, new)) + sum(map(len, unknown))

    def _learn(self, units: set[str]) -> None:
        """Encode new pieces: Latin ones by their words, other plain ones as the lines of one text, as a line break between them is a token of its own."""
        other = self._learn_latin(units)
        plain = [u for u in other if _PLAIN.fullmatch(u)]
        for i in range(0, len(plain), _LINES):
            part = plain[i : i + _LINES]
            ids = np.array(self.encode(["\n".join(part)])[0], "<u4")
            ends = np.append(np.flatnonzero(ids == self._break), len(ids))
            if len(ends) != len(part):
                raise ValueError("the vocabulary joins line breaks with their neighbours")
            start = 0
            for unit, end in zip(part, ends.tolist(), strict=True):
                self._ids[unit] = ids[start:end].tobytes()
                start = end + 1
        rest = [u for u in other if not _PLAIN.fullmatch(u)]
        for unit, ids in zip(rest, self.encode(rest), strict=True):
            self._ids[unit] = np.array(ids, "<u4").tobytes()
        self._chars += sum(map(len, units))

    def _learn_latin(self, units: set[str]) -> list[str]:
        """Encode the pieces in which ``_MATCH`` finds what the pattern does, a match once; returns the others.

        A match is a piece as well, so that it is kept as one.
        """
        latin, other = [], []
        for u in units:
            (latin if _LATIN.fullmatch(u) and not (self._added and self._added.search(u)) else other).append(u)
        parts = [(u,) if u.lstrip(" ").isalpha() else _MATCH.findall(u) for u in latin]
        known, tokenize = self._ids, self.tokenizer.model.tokenize
        for word in set(chain.from_iterable(parts)).difference(known):
            spelt = word.replace(" ", "\u0120") if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
            ids = [x.id for x in tokenize(spelt)]
            known[word] = struct.pack(f"<{len(ids)}I", *ids)
            if word not in units:
                self._chars += len(word)
        for unit, own in zip(latin, parts, strict=True):
            if len(own) > 1:
                known[unit] = b"".join(map(known.__getitem__, own))
        return other


#: In a word vocabulary's unit, a letter or digit ends a word in front of ASCII punctuation, as does punctuation in front of a
#: letter or digit, but for an apostrophe.
_INSIDE = re.compile(r"(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])(?=[!-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])")


def cut(text: str) -> list[str]:
    """The pieces of a text between places at which every byte-level pattern splits."""
    if any(x in text for x in _RUNS) or text[:1] in " \n" or text[-1:] in " \n" or any(x in text for x in _RARE):
        return _CUT.split(text)
    return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")


def _cuttable(spec: dict) -> bool:
    """Whether the file's rules split as :func:`cut` expects, and change nothing across a cut."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    calm = not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or [])
    return bool(plain and calm and not spec.get("normalizer"))


def _spaced(spec: dict, tokenizer) -> bool:
    """Whether the file's rules drop white space, and split letters, digits and punctuation as ``_INSIDE`` expects."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    calm = all(
        s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps
    )
    if not (calm and any(s["type"] == "Lowercase" for s in steps) and (spec.get("model") or {}).get("end_of_word_suffix")):
        return False
    if any(t.get("lstrip") or t.get("rstrip") or not t["content"].startswith("<|") for t in spec.get("added_tokens") or []):
        return False
    pieces = [x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str("ab c1?\n  it's,'d.(x)")]
    return pieces == ["ab", "c", "1", "?", "it", "'s", ",'", "d", ".(", "x", ")"]


class Pieces:
    """A tokenizer of the sentencepiece library, made from the bytes of its file."""

    cuttable = False

    def __init__(self, data: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def spans(self, text: str) -> np.ndarray:
        pieces = self.model.encode(text, return_type="proto").pieces
        found = np.array([(p.begin, p.end, p.id) for p in pieces], np.int64).reshape(-1, 3)
        # The library counts in bytes of UTF-8.
        heads = (np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80
        found[:, :2] = np.append(0, np.cumsum(heads))[found[:, :2]]
        return found

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.encode(texts)]


_LOADED: dict[bytes, Library | Pieces] = {}


def load(data: bytes) -> Library | Pieces:
    """The tokenizer of a file's bytes; a Python worker keeps it, with its cache, from task to task."""
    key = hashlib.md5(data).digest()
    if key not in _LOADED:
        _LOADED[key] = Library(data) if data.lstrip()[:1] == b"{" else Pieces(data)
    return _LOADED[key]


def broadcast_file(spark, path: str):
    """The bytes of a vocabulary file (a few MB, as fixed as the vocabulary), read by the driver."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())
