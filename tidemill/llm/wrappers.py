"""Main text of web pages by wrappers that are inferred for each host.

A page is a nested token stream of block elements and texts.  The wrapper of a host is a union-free regular expression
over such tokens.  Aligning it with the next page keeps what both have in the same order; a text mismatch becomes a
slot, tokens that only one side has an optional group, and stretches that differ in number or order a repeated group.
Matching goes by hashes (equal subtrees first, then elements of the same form, then the same sequence), so that it takes nearly linear
time, and a repeated group has one member for each label, so that wrappers stay small.  Wrappers align with each other in
the same way: tasks fold their pages, then the partial wrappers of a host are folded in two steps, one row at a time,
the first of which spreads each host over ``_SALTS`` tasks.

The wrapper says where the host's main text is, by the characters of its slots and of what not all pages have: the article or main element with most of them, or else
the innermost box that leaves no such paragraph, heading or larger part of them outside.  Text that is the same on all pages is template and doesn't
count; within a box that isn't an article it is also left out, unless it is the larger part, as in near copies of one page.
Where all pages of a host are the same, and on a page without its host's place, which is read by a wrapper of its own, all text counts.

Menus, headers, footers, sidebars, notices, adverts, forms and comments inside the place go.  They are known by their elements, or by a class, id or role
*all* of whose words say so (``ad-box``, not ``market-share``); a header inside an article is part of it, and so is a form that holds the page.  All other text is kept.

A null or broken page gives an empty or partial text and never fails; a null url is a host without a name.  Pages are read one by one,
so repeated rows give repeated results, and very long pages are read whole.  Other columns are not read.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm.common import id_type, map_columns, slices
from tidemill.session import stage

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"\s+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg".split())
_RAW_END = {x: re.compile(rf"</{x}(?![a-zA-Z0-9:-])[^>]*+(?:>|\Z)", re.I) for x in _RAW}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An element that ends open ones of these names, up to the given container.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select")}
_MAIN = frozenset("article main".split())
_SIDE = frozenset("nav header footer aside form head select button dialog menu".split())
_SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner nav navbar navigation menu header masthead footer sidebar aside cookie cookies notice notices consent popup "
    "modal promo sponsored social share related breadcrumb breadcrumbs comment comments commentlist disqus newsletter subscribe signup login search".split()
)
#: Words that may stand beside those in one name without changing what it says.
_NEUTRAL = frozenset(
    "article articles area bar block bottom box button buttons container content footer form global holder icons inner item items left links list main outer page panel post posts "
    "primary reader right secondary section site slot text thread title top unit user widget wrap wrapper".split()
)
#: Names that are part of an article when they stand inside one.
_HEADS = frozenset("header masthead banner".split())
#: Elements whose label has no names, as these differ from page to page or say nothing.
_BARE = frozenset("html body article main p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr td th tbody blockquote pre".split())
#: Elements that hold text and not parts of a page.
_TEXTUAL = _BARE - frozenset("html body article main".split()) | {"table", "figure", "figcaption"}
#: Levels of the tree that wrappers are aligned on; deeper text counts where the tree ends, and all elements stay open for reading.
_DEPTH = 64
#: Tasks over which the partial wrappers of one host are spread.
_SALTS = 256
#: Nodes of unfinished wrappers that a task holds before it hands them on.
_HELD_NODES = 300_000


@dataclass
class Node:
    """``label``: an element with its names, ``#`` a text, ``*`` a group.  ``mark``: a fixed text's checksum, None for a slot.

    ``key`` is a hash of the whole subtree as long as it is the same on all pages, else None; ``chars`` counts those of a fixed text once, of a slot on all pages.
    """

    label: str
    children: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    mark: int | None = None
    chars: int = 0
    key: int | None = None

    def pack(self) -> list:
        return [self.label, [x.pack() for x in self.children], self.optional, self.repeated, self.mark, self.chars, self.key]

    @staticmethod
    def unpack(row: list) -> Node:
        return Node(row[0], [Node.unpack(x) for x in row[1]], *row[2:])

    def size(self) -> int:
        return 1 + sum(x.size() for x in self.children)

    def expression(self) -> str:
        inner = " ".join(x.expression() for x in self.children)
        if self.label == "#":
            body = "#SLOT" if self.mark is None else "#TEXT"
        else:
            body = f"({inner})" if self.label == "*" else f"<{self.label}> {inner} </>"
        return (f"({body})+" if self.repeated else body) if not self.optional else f"({body}){'*' if self.repeated else '?'}"


def parse(page: str) -> tuple[Node, list[tuple[tuple[str, ...], str]]]:
    """The page as nested tokens, and its blocks: labels from the root (below ``_DEPTH`` only those of main and side elements), and decoded text."""
    root = Node("")
    # Name of each open element, its node in the tree, and its path of labels.
    stack: list[tuple[str, Node, tuple[str, ...]]] = [("", root, ())]
    open_names: Counter[str] = Counter()
    blocks, text = [], []

    def flush() -> None:
        joined = _SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if joined:
            blocks.append((stack[-1][2], joined))
            stack[-1][1].children.append(Node("#", mark=zlib.crc32(joined.encode("utf-8", "replace")), chars=len(joined)))

    def close(names: frozenset[str] | tuple, until: frozenset[str] | tuple = ()) -> None:
        if not any(open_names[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in until:
                return
            if stack[k][0] in names:
                flush()
                open_names.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in _INLINE:
            continue
        if m[1]:
            if name in _ENDS_P and name != "p":
                close(("p",), (name,))
            close((name,))
            if name == "p" or name == "br":
                text.append(" ")
            continue
        if name in _RAW:
            if not m[3].rstrip().endswith("/"):
                # Nothing inside is markup: only the literal end tag ends it.
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _VOID:
            text.append(" ")
            if name == "hr":
                close(("p",))
            continue
        if name in _ENDS_P:
            close(("p",), ("table", "td", "th", "button"))
        if name in _ENDS:
            names, until = _ENDS[name]
            close(names.split(), until.split())
        flush()
        label = _label(name, m[3], bool(open_names["article"] or open_names["main"]))
        _, node, path = stack[-1]
        if len(stack) < _DEPTH:
            node = Node(label)
            stack[-1][1].children.append(node)
            path = (*path, label)
        elif not _side(path[-1]) and (_side(label) or label in _MAIN and path[-1] not in _MAIN):
            # The tree ends here, but main and side elements must not be taken for their surroundings.
            node = Node(label)
            stack[-1][1].children.append(node)
            path = (*path, label)
        stack.append((name, node, path))
        open_names[name] += 1
    if at < len(page):
        text.append(html.unescape(page[at:]))
    flush()
    _hash(root)
    return root, blocks


def _label(name: str, attributes: str, in_article: bool) -> str:
    """The element with its classes (those without digits); ``!`` in front says that it is a side element."""
    if name in _BARE and name != "ul" or "=" not in attributes:
        return f"!{name}" if name in _SIDE and not (in_article and name == "header") else name
    names = {x for v in _NAMES.findall(attributes) for x in v.lower().strip("\"'").split()}
    side = name in _SIDE and not (in_article and name == "header") or any(_side_name(x, in_article) for x in names)
    shown = [] if name in _BARE else sorted(x for x in names if x.replace("-", "").replace("_", "").isalpha())
    return ("!" if side else "") + ".".join([name, *shown])


def _side_name(name: str, in_article: bool) -> bool:
    words = [x for x in re.split(r"[^a-z]+", name) if x]
    telling = [x for x in words if x in _SIDE_NAMES and not (in_article and x in _HEADS)]
    return bool(telling) and all(x in _SIDE_NAMES or x in _NEUTRAL for x in words)


def _side(label: str) -> bool:
    return label.startswith("!")


def _hash(node: Node) -> int:
    node.key = hash((zlib.crc32(node.label.encode("utf-8", "replace")), node.mark or 0, *map(_hash, node.children)))
    return node.key


def _align(a: Node, b: Node) -> Node:
    """The most special expression of this kind that covers both; labels are equal."""
    optional, repeated = a.optional or b.optional, a.repeated or b.repeated
    if a.key is not None and a.key == b.key:
        return Node(a.label, a.children, optional, repeated, a.mark, a.chars, a.key)
    if a.label == "#":
        same = a.mark is not None and a.mark == b.mark
        return Node("#", [], optional, repeated, a.mark if same else None, a.chars if same else a.chars + b.chars)
    if a.label == "*":
        return Node("*", _by_label([*a.children, *b.children]), optional, repeated)
    return Node(a.label, _pair(a.children, b.children, 0), optional, repeated)


def _pair(xs: list[Node], ys: list[Node], level: int) -> list[Node]:
    """Two lists of neighbours as one.  ``level``: what they are anchored by, equal subtrees (0) or elements of one form (1)."""
    if not xs or not ys:
        for x in (*xs, *ys):
            x.optional = True
        return [*xs, *ys]
    if len(xs) == len(ys) and all(x.label == y.label for x, y in zip(xs, ys, strict=True)):
        return [_align(x, y) for x, y in zip(xs, ys, strict=True)]
    if level == 2:
        return _repeat([*xs, *ys])
    out, i, j = [], 0, 0
    for m, n in _anchors([_anchor(x, level) for x in xs], [_anchor(y, level) for y in ys]):
        out += _pair(xs[i:m], ys[j:n], level + 1) if m > i or n > j else []
        out.append(_align(xs[m], ys[n]))
        i, j = m + 1, n + 1
    if i < len(xs) or j < len(ys):
        out += _pair(xs[i:], ys[j:], level + 1)
    return out


def _anchor(node: Node, level: int):
    if node.label == "*":
        return None
    return node.key if level == 0 else (node.label, frozenset(x.label for x in node.children))


def _anchors(xs: list, ys: list) -> list[tuple[int, int]]:
    """Places of keys that both lists have exactly once, as many as stay in order (longest increasing subsequence)."""
    once_x, once_y = Counter(xs), Counter(ys)
    place = {y: n for n, y in enumerate(ys) if y is not None and once_y[y] == 1}
    ends: list[int] = []
    rows: list[tuple[int, int, int]] = []
    tops: list[int] = []
    for m, x in enumerate(xs):
        n = place.get(x) if x is not None and once_x[x] == 1 else None
        if n is None:
            continue
        k = bisect_left(ends, n)
        rows.append((m, n, tops[k - 1] if k else -1))
        ends[k : k + 1], tops[k : k + 1] = [n], [len(rows) - 1]
    out, at = [], tops[-1] if tops else -1
    while at >= 0:
        m, n, at = rows[at]
        out.append((m, n))
    return out[::-1]


def _repeat(items: list[Node]) -> list[Node]:
    """Items of any number and order as one repeated group."""
    members = _by_label(items)
    if len(members) == 1:
        members[0].repeated = True
        return members
    for x in members:
        x.optional = True
    return [Node("*", members, repeated=True)]


def _by_label(items: list[Node]) -> list[Node]:
    found: dict[str, Node] = {}
    todo = items[::-1]
    while todo:
        x = todo.pop()
        if x.label == "*":
            todo += x.children[::-1]
        else:
            found[x.label] = _align(found[x.label], x) if x.label in found else x
    return list(found.values())


def _weights(wrapper: Node) -> dict[int, int]:
    """Characters of each node's text, by the node's identity, outside side elements within it; fixed text of all pages counts only if there is no other.

    A form that has more than all else beside it holds the page and counts.
    """

    def weigh(node: Node, varies: bool) -> int:
        varies = varies or node.optional
        if node.label == "#":
            out = node.chars if varies or node.mark is None else 0
        else:
            inner = [(x, weigh(x, varies)) for x in node.children]
            out = sum(n for x, n in inner if not _side(x.label))
            out = max([out, *(n for x, n in inner if x.label.startswith("!form"))])
        weights[id(node)] = out
        return out

    weights: dict[int, int] = {}
    # A wrapper whose pages are all the same has no slots.
    weigh(wrapper, wrapper.key is not None)
    return weights


def main_place(wrapper: Node) -> tuple[str, ...]:
    """The labels from the root to the main text."""
    weights = _weights(wrapper)

    def inner(node: Node) -> Iterator[Node]:
        for x in node.children:
            if x.label == "*":
                yield from inner(x)
            else:
                yield x

    def weight(node: Node) -> int:
        return weights[id(node)]

    best, todo = None, [((), wrapper)]
    while todo:
        path, node = todo.pop()
        for x in inner(node):
            here = (*path, x.label)
            if x.label in _MAIN and weight(x) and (best is None or weight(x) > best[0] or here[: len(best[1])] == best[1] and 2 * weight(x) > best[0]):
                best = (weight(x), here)
            # A form may hold the whole page.
            if x.label != "#" and (not _side(x.label) or x.label.startswith("!form")):
                todo.append((here, x))
    if best:
        return best[1]
    path, node = (), wrapper
    while True:
        items = list(inner(node))
        boxes = [x for x in items if x.label != "#" and not _side(x.label) and x.label.split(".")[0] not in _TEXTUAL]
        forms = [x for x in items if x.label.startswith("!form")]
        most = max(boxes, key=weight, default=None)
        form = max(forms, key=weight, default=None)
        if form and weight(form) > sum(weight(x) for x in items if not _side(x.label)):
            most = form
        elif most is None or 2 * weight(most) <= weight(node) or any(weight(x) for x in items if x is not most and x not in boxes and not _side(x.label)):
            return path
        path, node = (*path, most.label), most


def fixed_texts(wrapper: Node, place: tuple[str, ...], n_pages: int) -> list[int]:
    """Marks, with their paths, of the texts in a place that are the same on all pages, as far as they are its smaller part."""
    if wrapper.key is not None or any(x in _MAIN for x in place):
        return []
    out, fixed, todo = [], 0, [((), wrapper, False)]
    slots = 0
    while todo:
        path, node, varies = todo.pop()
        for x in node.children:
            free = varies or x.optional
            if x.label == "#":
                if path[: len(place)] != place:
                    continue
                if free or x.mark is None:
                    slots += x.chars
                else:
                    fixed += x.chars
                    out.append(_mark(path, x.mark))
            elif x.label == "*" or not _side(x.label) or len(path) < len(place):
                todo.append((path if x.label == "*" else (*path, x.label), x, free))
    return sorted(set(out)) if fixed * n_pages < slots else []


def _mark(path: tuple[str, ...], crc: int) -> int:
    return (zlib.crc32(" ".join(path).encode("utf-8", "replace")) & 0x7FFFFFFF) << 32 | crc


_PARTIAL = "host string, wrapper string, n_pages long"


def infer_wrappers(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each ``host`` with its wrapper as an expression, the number of pages, the place of the main text, and the fixed texts in it."""

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[Node, int]] = {}
        held = 0
        for batch in batches:
            for part in slices(batch):
                for host, page in zip(*[x.to_pylist() for x in part.columns], strict=True):
                    root = parse(page or "")[0]
                    node, n = found.get(host, (None, 0))
                    found[host] = (_align(node, root) if node else root, n + 1)
                    if not n or n & (n + 1) == 0:
                        held += found[host][0].size()
                    if held > _HELD_NODES:
                        yield _partial([(k, *v) for k, v in found.items()])
                        found, held = {}, 0
        if found:
            yield _partial([(k, *v) for k, v in found.items()])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Node, int]]:
        """Rows come sorted by host, so only one wrapper is held."""
        now = None
        for batch in batches:
            for part in slices(batch):
                for host, packed, n in zip(*[x.to_pylist() for x in part.columns], strict=True):
                    node = Node.unpack(json.loads(packed))
                    if now and now[0] == host:
                        now = (host, _align(now[1], node), now[2] + n)
                    else:
                        if now:
                            yield now
                        now = (host, node, n)
        if now:
            yield now

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in merged(batches):
            yield _partial([row])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, node, n in merged(batches):
            place = main_place(node)
            columns = [[host], [node.expression()], [n], [list(place)], [fixed_texts(node, place, n)]]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["host", "wrapper", "n_pages", "place", "fixed"])

    pages = df.select(host_of(c(url_col)).alias("host"), c(html_col).alias("html"))
    partial = pages.mapInArrow(of_pages, _PARTIAL)
    salt = F.pmod(F.crc32(c("wrapper").cast("binary")), F.lit(_SALTS))
    partial = partial.repartition("host", salt).sortWithinPartitions("host", "wrapper").mapInArrow(some, _PARTIAL)
    partial = partial.repartition("host").sortWithinPartitions("host", "wrapper")
    return partial.mapInArrow(whole, "host string, wrapper string, n_pages long, place array<string>, fixed array<bigint>")


def _partial(rows: list[tuple[str, Node, int]]) -> pa.RecordBatch:
    hosts, nodes, counts = zip(*rows, strict=True)
    packed = [json.dumps(x.pack(), separators=(",", ":")) for x in nodes]
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(packed, pa.string()), pa.array(counts, pa.int64())], names=["host", "wrapper", "n_pages"])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page, its blocks joined by single spaces."""
    places = stage(infer_wrappers(df, url_col, html_col).select("host", "place", "fixed"), "wrappers")
    pages = df.select(c(id_col).alias("id"), c(url_col).alias("url"), c(html_col).alias("html"), host_of(c(url_col)).alias("host"))
    # Spark broadcasts the places only if the stored table is below its threshold.
    joined = pages.join(places, "host", "left")

    def read(ids, urls, pages, places, fixed):
        texts = [_main_text(page or "", tuple(place or ()), marks or ()) for page, place, marks in zip(pages, places, fixed, strict=True)]
        return [ids, urls, texts, [len(t) for t in texts]]

    schema = f"`{id_col}` {id_type(df, id_col)}, `{url_col}` string, text string, n_chars long"
    return map_columns(joined, ["id", "url", "html", "place", "fixed"], schema, read)


def _main_text(page: str, place: tuple[str, ...], fixed: Sequence[int] = ()) -> str:
    root, blocks = parse(page)
    found = [x for x in blocks if x[0][: len(place)] == place]
    if not found:
        place, fixed = main_place(root), ()
        found = [x for x in blocks if x[0][: len(place)] == place]
    kept = [x for x in found if not any(map(_side, x[0][len(place) :]))]
    if fixed:
        template = frozenset(fixed)
        kept = [x for x in kept if _mark(x[0], zlib.crc32(x[1].encode("utf-8", "replace"))) not in template]
    return " ".join(text for _, text in kept)
