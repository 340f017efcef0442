"""One parse of a page into an array of nodes, and column functions over that array.

A node's place in the array is its number in document order, and ``last`` is
the number of its last descendant. So a subtree is a slice of the array, and
everything that is read from a page stays within the page's row: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from answerloom import fixed_values as V
from answerloom.functions.text import UNICODE, strip

_FIELDS = {
    "pre": T.IntegerType(),
    "last": T.IntegerType(),
    "level": T.IntegerType(),
    "parent": T.IntegerType(),
    "tag": T.StringType(),
    "attrs": T.MapType(T.StringType(), T.StringType()),
    "text": T.StringType(),
    "pruned": T.BooleanType(),  # inside an element that extraction leaves out
    "shown": T.BooleanType(),  # not inside a script, style or head
    "breaks": T.BooleanType(),  # a block began or ended since the text before
    "owner": T.IntegerType(),  # nearest table around it
    "row": T.IntegerType(),  # place of a row or cell in its table
    "col": T.IntegerType(),
    "rowspan": T.IntegerType(),
    "colspan": T.IntegerType(),
}

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template head title".split())
_BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul br".split()
)
# An opening tag ends these open elements, up to the nearest element of the scope.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul".split()
)
_CELL_EDGE = frozenset({"td", "th", "table"})
_TABLE_TAGS = frozenset("td th tr thead tbody tfoot table body html".split())
_PRUNED = frozenset(V.PRUNED_TAGS)
_MAX_COLSPAN = 1000  # fixed by the HTML standard; rows are limited by the table they are in


def _span(value: str | None) -> int:
    return max(1, int(value)) if value and re.fullmatch(r"\s*[0-9]+\s*", value) else 1


# A comment, a tag with its attributes, or another declaration. A quote opens a value only after "=".
_MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(>|\Z)|<[!?/][^>]*+>?""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "textarea", "title")}
_LITERAL = frozenset({"script", "style"})  # no entities inside


def _attributes(source: str) -> dict[str, str]:
    """Attributes by lower-case name; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


class _Shredder:
    """Collects the nodes of one page, tolerating unclosed and stray tags."""

    def __init__(self) -> None:
        self.nodes: list[list] = []
        self.open: list[list] = []
        self.texts: list[str] = []
        self.breaks = False
        self.paragraphs = 0  # open ones
        self.grids: dict[int, dict] = {}

    def read(self, page: str) -> list[list]:
        at = 0
        end = len(page)
        search, texts = _MARKUP.search, self.texts
        while at < end:
            found = search(page, at)
            if found is None:
                self.text(page[at:])
                break
            begin, stop = found.span()
            if begin > at:
                self.text(page[at:begin])
            at = stop
            slash, name, attributes, closed = found.groups()
            if name is not None and not closed:
                break  # the page ends inside a tag
            if texts:
                self._flush()
            if name is None:
                continue
            if slash:
                self.end_tag(name.lower())
            else:
                name = name.lower()
                self.start_tag(name, attributes)
                if name in _RAW and not attributes.endswith("/"):
                    stop = _RAW[name].search(page, at)
                    body_end = stop.start() if stop else end
                    if body_end > at:
                        self.text(page[at:body_end], literal=name in _LITERAL)
                    at = body_end
        self._flush()
        self._close_to(0)
        for grid in self.grids.values():  # no cell reaches beyond its table's last row
            for cell in grid["cells"]:
                cell[13] = min(cell[13], max(grid["row"], 0) + 1 - cell[11])
        return self.nodes

    def text(self, text: str, literal: bool = False) -> None:
        self.texts.append(unescape(text) if "&" in text and not literal else text)

    def _flush(self) -> None:
        """The text collected, if any, becomes a node."""
        texts = self.texts
        if texts:
            text = texts[0] if len(texts) == 1 else "".join(texts)
            texts.clear()
            if text.isspace():
                self._add("#text", (), "\n" if "\n" in text else " ")
            else:
                self._add("#text", (), text)
                self.breaks = False

    def _add(self, tag: str, attrs: Iterable[tuple[str, str]], text: str | None) -> list:
        nodes, opened = self.nodes, self.open
        pre = len(nodes)
        if opened:
            up = opened[-1]
            parent, pruned, shown = up[0], up[7], up[8]
            owner = parent if up[4] == "table" else up[10]
        else:
            parent, pruned, shown, owner = -1, False, True, -1
        node = [
            pre, pre, len(opened), parent, tag, list(attrs), text,
            pruned or tag in _PRUNED, shown and tag not in _HIDDEN, self.breaks, owner, -1, -1, 1, 1,
        ]
        nodes.append(node)
        return node

    def _close_to(self, depth: int) -> None:
        last = len(self.nodes) - 1
        for node in self.open[depth:]:
            node[1] = last
            if node[4] == "p":
                self.paragraphs -= 1
        del self.open[depth:]

    def _end_implied(self, tags: Iterable[str], scope: Iterable[str]) -> None:
        depth = None
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][4]
            if name in scope:
                break
            if name in tags:
                depth = i
        if depth is not None:
            self._close_to(depth)

    def _place_cell(self, node: list, attrs: dict) -> None:
        grid = self.grids.get(node[10]) or self.grids.setdefault(node[10], {"row": 0, "taken": {}, "cells": []})
        row = max(grid["row"], 0)
        col = 0
        taken = grid["taken"]
        while taken.get(col, -1) >= row:
            col += 1
        node[11], node[12] = row, col
        node[13], node[14] = _span(attrs.get("rowspan")), min(_span(attrs.get("colspan")), _MAX_COLSPAN)
        for c in range(col, col + node[14]):
            taken[c] = row + node[13] - 1
        grid["cells"].append(node)

    def start_tag(self, tag: str, source: str) -> None:
        if tag in _BLOCK:
            self.breaks = True
        if tag in _ENDS:
            self._end_implied(*_ENDS[tag])
        if self.paragraphs and tag in _ENDS_P:
            self._end_implied(("p",), _CELL_EDGE)
        attrs = _attributes(source) if source else {}
        node = self._add(tag, attrs.items(), None)
        if tag == "tr":
            grid = self.grids.get(node[10]) or self.grids.setdefault(node[10], {"row": -1, "taken": {}, "cells": []})
            grid["row"] += 1
            node[11] = grid["row"]
        elif tag in ("td", "th"):
            self._place_cell(node, attrs)
        if tag not in _VOID and not source.endswith("/"):
            self.open.append(node)
            if tag == "p":
                self.paragraphs += 1

    def end_tag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.breaks = True
        opened = self.open
        crosses = tag in _TABLE_TAGS
        for i in range(len(opened) - 1, -1, -1):
            name = opened[i][4]
            if name == tag:
                self._close_to(i)
                return
            if not crosses and name in _CELL_EDGE:
                return


def shred(page: str) -> list[list]:
    """The nodes of one page, in document order."""
    return _Shredder().read(page)


_ARROW_TYPES = [to_arrow_type(t) for t in _FIELDS.values()]
_PLACES = {n: i for i, n in enumerate(_FIELDS)}


_PORTION_BYTES = 1 << 20  # of HTML that is held as nodes in Python at a time


def _portions(pages: pa.Array) -> Iterator[pa.Array]:
    """Runs of pages of about ``_PORTION_BYTES``; a longer page is alone."""
    sizes = pc.fill_null(pc.binary_length(pages), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > _PORTION_BYTES:
            yield pages.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(pages):
        yield pages.slice(start)


def _parsed(pages: pa.Array, fields: Sequence[str] = tuple(_FIELDS)) -> pa.Array:
    places = [_PLACES[f] for f in fields]
    offsets: list[int | None] = []
    columns: list[list] = [[] for _ in fields]
    count = 0
    for page in pages:
        if not page.is_valid:
            offsets.append(None)
            continue
        offsets.append(count)
        nodes = shred(page.as_py())
        count += len(nodes)
        for column, at in zip(columns, places):
            column.extend([n[at] for n in nodes])
    offsets.append(count)
    arrays = [pa.array(c, type=_ARROW_TYPES[at]) for c, at in zip(columns, places)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, list(fields)))


def html_nodes(html: Column, fields: Sequence[str] = tuple(_FIELDS)) -> Column:
    """Nodes of pages with these fields, in batches by the size of the pages, not by their number: a worker's memory does not grow with the table."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, _FIELDS[n]) for n in fields])))
    def html_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for portion in _portions(pages):
                yield _parsed(portion, fields)

    return html_nodes(html)


# Column functions over the array of nodes -------------------------------------------------


def subtree(nodes: Column, node: Column) -> Column:
    """The descendants of a node."""
    return F.slice(nodes, node["pre"] + 2, node["last"] - node["pre"])


def elements(nodes: Column, *tags: str, pruned: bool = False) -> Column:
    """Elements with one of the tags; ``pruned`` leaves out what pruned tags hold."""
    return F.filter(nodes, lambda n: n["tag"].isin(*tags) & (~n["pruned"] if pruned else F.lit(True)))


def _pieces(nodes: Column, pruned: bool) -> Column:
    kept = F.filter(nodes, lambda n: (n["tag"] == "#text") & (~n["pruned"] if pruned else F.lit(True)))
    return F.transform(kept, lambda n: n["text"])


def raw_text(nodes: Column, pruned: bool = False) -> Column:
    """All text as it is."""
    return F.array_join(_pieces(nodes, pruned), "")


def stripped_text(nodes: Column, separator: str = "", pruned: bool = False) -> Column:
    """Stripped pieces of text, empty ones left out."""
    pieces = F.transform(_pieces(nodes, pruned), strip)
    return F.array_join(F.filter(pieces, lambda p: p != ""), separator)


def rendered_text(nodes: Column) -> Column:
    """Text as shown: blanks run together, a line break where a block begins or ends."""
    shown = F.filter(nodes, lambda n: (n["tag"] == "#text") & n["shown"])
    pieces = F.transform(
        shown,
        lambda n: F.concat(F.when(n["breaks"], F.lit("\x00")).otherwise(""), n["text"]),
    )
    joined = F.regexp_replace(F.array_join(pieces, ""), UNICODE + r"\s+", " ")
    return strip(F.regexp_replace(F.regexp_replace(joined, " ?(?:\x00 ?)+", "\n"), "\x00", ""))
