"""Personal data: patterns find protected entities, co-occurrence finds the terms that reveal them.

Patterns (e-mail, IP address, card, phone) give the base spans.  Entities are the exact values and pools of them: the kind,
the mail domain, the network of an address, the leading digits of a card or phone.  Terms are all words of two characters or more
outside a document's base spans, with their digits and underscores (account names, numbers, keys), and each two neighbouring characters
of scripts without spaces; terms of such a run may overlap.  With document counts over the whole corpus, a term discloses an entity if documents with the term
mostly hold the entity (``min_share``) and if both meet more often than chance explains: the log-likelihood ratio of their
counts is at least 2 ln(entities * documents), so the support that is asked for follows from the counts.  A single
document never reaches it, two documents that alone hold a value and a term usually do.  In documents that hold the entity such
terms become spans too.  Sanitised texts have the kind in place of a base span; a term that is nearly an identifier
(``remove_share``) is removed, other revealing terms are generalised to ``[TERM]``.

A null text counts as empty; a text of any length is read whole, and held by one task.  Rows are treated one by one, repeated rows count as documents of their own; other columns
are not read.  What is sent to the executors (entities, candidate terms, revealing pairs) is counted first; beyond
``BROADCAST_TERMS`` it is joined instead.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm.common import id_type, map_columns, slices
from tidemill.session import stage

#: Terms or pairs that go to the executors as a set, about 150 bytes each there.
BROADCAST_TERMS = 300_000
#: Counted pairs that a task holds before it sends them on.
PAIRS = 200_000

KINDS = ("email", "ip", "card", "phone")
_EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Scripts written without spaces: Thai to Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(r"\w{2,}")
_WORD_OR_RUN = re.compile(rf"[^\W{_UNSPACED}]{{2,}}|([{_UNSPACED}]{{2,}})")


@dataclass(frozen=True)
class Disclosure:
    min_share: float = 0.5
    remove_share: float = 0.9


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans as (start, number of the kind, end), ascending."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_LEFT:
            start -= 1
        if start < at and (m := _EMAIL_RIGHT.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(x.isdigit() for x in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _entity(text: str, span: tuple[int, int, int]) -> str:
    """The mention without its spelling: lower-case address, or digits only (with the dots of an IP address)."""
    value = text[span[0] : span[2]]
    if span[1] == 0:
        value = value.lower()
    elif span[1] > 1:
        value = "".join(x for x in value if x.isdigit())
    return f"{KINDS[span[1]]}:{value}"


def _pooled(entity: str) -> tuple[str, ...]:
    """The entity and the pools that it belongs to."""
    kind, value = entity.split(":", 1)
    if kind == "email":
        part = value[value.index("@") :]
    elif kind == "ip":
        part = value[: value.rindex(".") + 1]
    else:
        part = (value[:6] if kind == "card" else value[:-7]) + "*"
    return entity, f"{kind}:{part}", kind


def _entities(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    return {x for s in spans for x in _pooled(_entity(text, s))}


def _terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Terms that touch no base span, lower-cased, with their places: words and numbers, and pairs of characters of unspaced scripts."""
    out, k, end = [], 0, 0
    for m in (_WORD if text.isascii() else _WORD_OR_RUN).finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            end = max(end, spans[k][2])
            k += 1
        if end > m.start():
            continue
        if m.lastindex:
            out += [(text[i : i + 2], i, i + 2) for i in range(m.start(), m.end() - 1)]
        else:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def _surprise(both: Column, entity: Column, term: Column, total: float) -> Column:
    """Log-likelihood ratio of two counts that meet ``both`` times among ``total``."""

    def cell(n: Column, row: Column, column: Column) -> Column:
        return F.when(n > 0, n * F.ln(n * total / (row * column))).otherwise(0.0)

    both, entity, term = (x.cast("double") for x in (both, entity, term))
    parts = cell(both, entity, term) + cell(entity - both, entity, total - term) + cell(term - both, total - entity, term)
    return 2 * (parts + cell(total - entity - term + both, total - entity, total - term))


def revealing_terms(df: DataFrame, text_col: str = "text", rule: Disclosure = Disclosure(), broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Pairs of ``entity`` and ``term`` above the thresholds, with ``share`` = p(entity | term) and ``surprise``."""
    send = df.sparkSession.sparkContext.broadcast

    def holders(texts):
        seen = Counter(e for t in texts if t for e in _entities(t, find_spans(t)))
        return [list(seen), list(seen.values())]

    held = map_columns(df, [text_col], "entity string, n long", holders).groupBy("entity").agg(F.sum("n").alias("n_entity"))
    held = stage(held, "pii-entities")
    total = float(max(df.count(), 1))
    least = 2 * math.log(max(held.count(), 1) * total)
    # An entity, and then a pair, whose best possible term falls short needs no counting.
    entities = held.where(_surprise(c("n_entity"), c("n_entity"), c("n_entity"), total) >= least)
    some = send(frozenset(r.entity for r in entities.collect())) if entities.count() <= broadcast_terms else None

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            rows = [(e, x, n) for (e, x), n in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_pylist([dict(zip(("entity", "term", "n"), r, strict=True)) for r in rows], kind)

        kind = pa.schema([("entity", pa.string()), ("term", pa.string()), ("n", pa.int64())])
        seen: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for texts in (part.column(0).to_pylist() for part in slices(batch)):
                for t in texts:
                    spans = find_spans(t) if t else []
                    own = _entities(t, spans) if spans else set()
                    own = own if some is None else own & some.value
                    words = {w for w, _, _ in _terms(t, spans)} if own else set()
                    for e in own:
                        seen.update((e, w) for w in words)
                        if len(seen) >= PAIRS:
                            yield counted()
        if seen:
            yield counted()

    pairs = df.select(c(text_col)).mapInArrow(meetings, "entity string, term string, n long")
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both")).join(entities, "entity")
    best = _surprise(c("n_both"), c("n_entity"), c("n_both"), total)
    pairs = stage(pairs.where((best >= least) & (c("n_both") * total > c("n_entity") * c("n_both"))), "pii-pairs")
    wanted = pairs.select("term").distinct()
    known = send(frozenset(r.term for r in wanted.collect())) if wanted.count() <= broadcast_terms else None

    def occurrences(texts):
        seen: Counter[str] = Counter()
        for t in texts:
            words = {w for w, _, _ in _terms(t, find_spans(t))} if t else set()
            seen.update(words if known is None else known.value & words)
        return [list(seen), list(seen.values())]

    seen = map_columns(df, [text_col], "term string, n long", occurrences).groupBy("term").agg(F.sum("n").alias("n_term"))
    scored = pairs.join(seen, "term")
    scored = scored.withColumn("share", F.col("n_both") / F.col("n_term")).withColumn("surprise", _surprise(c("n_both"), c("n_entity"), c("n_term"), total))
    above = (F.col("share") >= rule.min_share) & (F.col("surprise") >= least) & (F.col("n_both") * total > F.col("n_entity") * F.col("n_term"))
    return scored.where(above).select("entity", "term", "share", "surprise")


def sanitise(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Disclosure = Disclosure(), broadcast_terms: int = BROADCAST_TERMS
) -> DataFrame:
    """Each row's base spans and revealing terms (``kind``, ``start``, ``end``) and its sanitised text."""
    pairs = stage(revealing_terms(df, text_col, rule, broadcast_terms), "pii-terms")
    kind = id_type(df, id_col)
    schema = f"`{id_col}` {kind}, spans array<struct<kind: string, start: int, end: int>>, sanitised string"
    rows = df.select(c(id_col).alias("id"), c(text_col).alias("text"))
    if pairs.count() <= broadcast_terms:
        table: dict[str, dict[str, float]] = defaultdict(dict)
        for r in pairs.collect():
            table[r.entity][r.term] = r.share
        known = df.sparkSession.sparkContext.broadcast(dict(table))
        return map_columns(rows, ["id", "text"], schema, lambda ids, texts: [ids, *_sanitised(texts, [None] * len(ids), known.value, rule)])

    def held_pairs(texts):
        keys, entities, terms = [], [], []
        for t in texts:
            spans = find_spans(t) if t else []
            words = {w for w, _, _ in _terms(t, spans)} if spans else ()
            key = hashlib.md5(t.encode("utf-8", "replace")).hexdigest() if spans else None
            for e in _entities(t, spans) if spans else ():
                keys += [key] * len(words)
                entities += [e] * len(words)
                terms += words
        return [keys, entities, terms]

    held = map_columns(rows, ["text"], "text_key string, entity string, term string", held_pairs).join(pairs, ["entity", "term"])
    shares = held.groupBy("text_key", "term").agg(F.max("share").alias("share"))
    shares = shares.groupBy("text_key").agg(F.collect_list("term").alias("terms"), F.collect_list("share").alias("shares"))
    joined = rows.withColumn("text_key", F.md5("text")).join(shares, "text_key", "left")

    def work(ids, texts, terms, shares):
        own = [dict(zip(t, s, strict=True)) if t else {} for t, s in zip(terms, shares, strict=True)]
        return [ids, *_sanitised(texts, own, {}, rule)]

    return map_columns(joined, ["id", "text", "terms", "shares"], schema, work)


def _sanitised(texts, own, table, rule: Disclosure) -> list[list]:
    """``own``: the revealing terms of a text if they are known already; else ``table`` has them by entity."""
    all_spans, all_texts = [], []
    for text, terms in zip(texts, own, strict=True):
        text = text or ""
        spans = find_spans(text)
        words = _terms(text, spans) if spans else []
        if terms is None:
            near = [table[e] for e in _entities(text, spans) if e in table]
            terms = {w: max(x.get(w, 0) for x in near) for w in {w for w, _, _ in words} if any(w in x for x in near)}
        found = [(s, k, e, f"[{KINDS[k].upper()}]") for s, k, e in spans]
        if terms:
            for word, start, end in words:
                if word in terms:
                    found.append((start, len(KINDS), end, "" if terms[word] >= rule.remove_share else "[TERM]"))
        found.sort()
        parts, at = [], 0
        for start, _, end, instead in found:
            if start >= at:
                parts += [text[at:start], instead]
            at = max(at, end)
        all_spans.append([{"kind": (*KINDS, "term")[k], "start": s, "end": e} for s, k, e, _ in found])
        all_texts.append("".join([*parts, text[at:]]))
    return [all_spans, all_texts]
