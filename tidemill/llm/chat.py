"""Chat formatting: layouts are recognised by a fingerprint of their field paths and mapped to canonical turns.

A record is JSON.  Its fingerprint is a hash of the sorted paths of its fields, where list items share one path and a
layout may name fields that can be absent.  Each fingerprint selects a declarative mapping, which lists where roles and
texts are; no layout has code of its own.  Turns are written with a template whose control strings cannot come from a
text: inside texts and roles they are replaced by an escape character and a number, which reading back undoes.

Null texts and roles are empty.  A record that is null, no JSON object, of an unknown layout, or with a list item that is no
object has ``mapping`` null and no turns, and is reported, not dropped or shortened.  Texts are formatted whole, however long.  Other columns
are not read; repeated rows and null ids are formatted alike.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm.common import id_type, map_columns


@dataclass(frozen=True)
class Mapping:
    """``fields``: (role, field) in order; then ``items``: the list of turns with its role and text fields.

    ``optional`` paths may be absent; those of items that are neither role nor text say something about a turn but are no
    part of it.  ``roles`` renames roles.
    """

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))

    def paths(self) -> list[str]:
        items = [self.items, f"{self.items}[]", f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"] if self.items else []
        return [*(f for _, f in self.fields), *items]

    def accepts(self, record: dict) -> bool:
        """Whether the items are a list of objects; a fingerprint alone does not tell."""
        items = record.get(self.items) if self.items else None
        return items is None or (isinstance(items, list) and all(isinstance(x, dict) for x in items))

    def turns(self, record: dict) -> list[tuple[str, str]]:
        found = [(role, record.get(f)) for role, f in self.fields if record.get(f) not in (None, "") or f not in self.optional]
        if self.items:
            found += [(x.get(self.role), x.get(self.text)) for x in record.get(self.items) or []]
        names = dict(self.roles)
        return [(names.get(_text(role), _text(role)), _text(text)) for role, text in found]


_SYSTEM = (("system", "system"),)
MAPPINGS = (
    Mapping("messages", "messages", "role", "content", _SYSTEM, ("system", "messages[].name", "messages[].id")),
    Mapping("turns", "turns", "role", "text", _SYSTEM, ("system", "turns[].name", "turns[].id")),
    Mapping("share", "conversations", "from", "value", _SYSTEM, ("system", "conversations[].name", "conversations[].id")),
    Mapping("dialog", "dialog", "speaker", "text", _SYSTEM, ("system", "dialog[].name", "dialog[].id")),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("question", fields=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system",)),
)

#: Fields that say something about a record but are no part of its turns.
METADATA = frozenset({"id", "source", "lang", "conv_id", "title", "meta"})


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(record: dict, metadata: frozenset[str] = METADATA) -> set[str]:
    """The paths of all fields but those of metadata; an empty list is taken for one of complete items."""
    found: set[str] = set()
    todo = [(k, v) for k, v in record.items() if k not in metadata]
    while todo:
        path, value = todo.pop()
        found.add(path)
        if isinstance(value, dict):
            todo += [(f"{path}.{k}", v) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(f"{path}[]", v) for v in value]
    return found


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """Every fingerprint that a mapping accepts: one for each choice of its optional paths."""
    found: dict[str, Mapping] = {}
    for m in mappings:
        own = [p for p in m.paths() if p not in m.optional]
        for n in range(len(m.optional) + 1):
            for chosen in itertools.combinations(m.optional, n):
                found.setdefault(fingerprint([*own, *chosen]), m)
                if m.items and not any(x.startswith(f"{m.items}[]") for x in chosen):  # no turns
                    found.setdefault(fingerprint([x for x in [*own, *chosen] if not x.startswith(f"{m.items}[]")]), m)
    return found


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    #: Strings that may not appear inside a text: the template's own and those of other common templates.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\x1a"

    def guard(self, text: str) -> str:
        codes = {s: f"{self.escape}{chr(ord('A') + i)}" for i, s in enumerate((self.escape, *self.control))}
        return re.sub("|".join(map(re.escape, codes)), lambda m: codes[m[0]], text)

    def unguard(self, text: str) -> str:
        strings = (self.escape, *self.control)
        return re.sub(f"{self.escape}(.)", lambda m: strings[ord(m[1]) - ord("A")], text, flags=re.S)

    def write(self, turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
        """The formatted text and, as flat pairs of start and end, the spans that a loss counts: assistant texts."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.start}{self.guard(role).replace('\n', self.escape + 'Z')}\n", self.guard(text)
            if role == "assistant":
                spans += [at + len(head), at + len(head) + len(body)]
            parts += [head, body, self.end, "\n"]
            at += len(head) + len(body) + len(self.end) + 1
        return "".join(parts), spans

    def read(self, formatted: str) -> list[tuple[str, str]]:
        turns = []
        for part in formatted.split(f"{self.end}\n")[:-1]:
            role, _, text = part.removeprefix(self.start).partition("\n")
            turns.append((self.unguard(role.replace(self.escape + "Z", "\n")), self.unguard(text)))
        return turns


def format_records(df: DataFrame, id_col: str, record_col: str, mappings=MAPPINGS, template: Template = Template()) -> DataFrame:
    """``formatted`` text and ``loss_spans`` of each record, with its ``fingerprint`` and the ``mapping`` it selected."""
    known = registry(mappings)

    def work(ids, records):
        rows = []
        for raw in records:
            record = _parse(raw)
            key = fingerprint(field_paths(record)) if record is not None else None
            mapping = known.get(key)
            if mapping and not mapping.accepts(record):
                mapping = None
            rows.append((key, mapping.name if mapping else None, *template.write(mapping.turns(record) if mapping else [])))
        return [ids, *map(list, zip(*rows, strict=True))]

    schema = f"`{id_col}` {id_type(df, id_col)}, fingerprint string, mapping string, formatted string, loss_spans array<int>"
    return map_columns(df, [id_col, record_col], schema, work)


def summarise(formatted: DataFrame, id_col: str, template: Template = Template()) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask, read back from the formatted text."""

    def work(ids, texts, spans):
        rows = []
        for text, pairs in zip(texts, spans, strict=True):
            turns = template.read(text)
            loss = "".join(template.unguard(text[a:b]) for a, b in zip(pairs[::2], pairs[1::2], strict=True))
            rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(text)))
        return [ids, *map(list, zip(*rows, strict=True))]

    schema = f"`{id_col}` {id_type(formatted, id_col)}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_columns(formatted, [id_col, "formatted", "loss_spans"], schema, work)


def records_of_turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One JSON record (``record``) for each conversation of a table with a row for each turn.

    Turns come by number, equal numbers by role and text; a null number comes first.
    """
    turn = F.struct(c(turn_col).alias("turn"), F.coalesce(c(role_col), F.lit("")).alias("role"), F.coalesce(c(text_col), F.lit("")).alias("text"))
    grouped = df.groupBy(c(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(id_col, F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))).alias("record"))


def _parse(raw: str | None) -> dict | None:
    try:
        record = json.loads(raw) if raw else None
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
