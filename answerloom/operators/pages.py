"""What a corpus of web pages holds: text, tables, lists, key/values, links, media.

Every operator takes the pages with their ``nodes`` column, as ``parse_pages``
adds it, so a page is parsed once for any number of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.functions import html_nodes as H
from answerloom.functions.text import UNICODE, all_matches, strip
from answerloom.functions.urls import host, is_data_link, resolve_url
from answerloom.plans.ranges import spread

NODES = "nodes"


CSS_FIELDS = ("pre", "last", "parent", "tag", "attrs", "text", "pruned")


def parse_pages(pages: DataFrame, html: str = "html", fields: Sequence[str] | None = None) -> DataFrame:
    """Adds the ``nodes`` of each page. Write the result to a table to use it often.

    With ``fields`` the nodes have these alone; ``CSS_FIELDS`` are all that selectors need.
    """
    return spread(pages).withColumn(NODES, H.html_nodes(F.col(html), *([fields] if fields else [])))


def shred_html(parsed: DataFrame, page: str = "page_id") -> DataFrame:
    """The nodes as rows."""
    return parsed.select(page, F.explode(NODES).alias("n")).select(page, "n.*")


def page_text(parsed: DataFrame, page: str = "page_id") -> DataFrame:
    """Stripped pieces of text on their own lines, without navigation, scripts and the like."""
    return parsed.select(page, H.stripped_text(F.col(NODES), "\n", pruned=True).alias("text"))


def _cell_text(nodes: Column, cell: Column) -> Column:
    return F.regexp_replace(strip(H.raw_text(H.subtree(nodes, cell))), UNICODE + r"[\r\n]+|\s{2,}", " ")


def _table_cells() -> Column:
    """The cells of a page's tables, each with the rows and columns it covers."""
    nodes = F.col(NODES)
    tables = F.transform(H.elements(nodes, "table", pruned=True), lambda t: t["pre"])
    return F.transform(
        F.filter(H.elements(nodes, "td", "th", pruned=True), lambda c: c["owner"] >= 0),
        lambda c: F.struct(
            (F.array_position(tables, c["owner"]) - 1).cast("int").alias("table_idx"),
            F.sequence(c["row"], c["row"] + c["rowspan"] - 1).alias("rows"),
            F.sequence(c["col"], c["col"] + c["colspan"] - 1).alias("cols"),
            (c["tag"] == "th").alias("is_header"),
            _cell_text(nodes, c).alias("text"),
        ),
    )


def page_tables(parsed: DataFrame, page: str = "page_id") -> DataFrame:
    """Every cell of every table. A cell that spans is repeated in each place it covers."""
    placed = parsed.select(page, F.explode(_table_cells()).alias("c"))
    rows = placed.select(page, "c.table_idx", F.explode("c.rows").alias("row_idx"), "c.cols", "c.is_header", "c.text")
    return rows.select(page, "table_idx", "row_idx", F.explode("cols").alias("col_idx"), "is_header", "text")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def page_named_cells(parsed: DataFrame, page: str = "page_id") -> DataFrame:
    """Each cell below row 0 with the name that row 0 has in its column: (page, table_idx, row, col_idx, name, value).

    The names are in the page's own row, and cells meet them there before they become rows: pages are parsed once, cells are made
    once, and nothing is shuffled.
    """

    def placed(cell: Column, heads: Column) -> Column:
        def named(row: Column, col: Column) -> Column:
            above = F.filter(heads, lambda h: F.array_contains(h["cols"], col))
            name = F.get(above, F.lit(0))["text"]
            return F.struct(cell["table_idx"].alias("table_idx"), (row - 1).alias("row"), col.alias("col_idx"), name.alias("name"), cell["text"].alias("value"))

        below = F.filter(cell["rows"], lambda r: r > 0)
        return F.flatten(F.transform(below, lambda r: F.transform(cell["cols"], lambda c: named(r, c))))

    def of_page(cells: Column, heads: Column) -> Column:
        own = lambda cell: F.filter(heads, lambda h: h["table_idx"] == cell["table_idx"])
        return F.flatten(F.transform(cells, lambda cell: _bound(own(cell), lambda found: placed(cell, found))))

    heads = lambda cells: F.filter(cells, lambda c: F.array_contains(c["rows"], 0))
    listed = _bound(_table_cells(), lambda cells: _bound(heads(cells), lambda found: of_page(cells, found)))
    return parsed.select(page, F.explode(listed).alias("c")).select(page, "c.*")


def page_lists(parsed: DataFrame, page: str = "page_id", pruned: bool = True) -> DataFrame:
    """Lists with their direct items; empty items and empty lists are left out."""
    nodes = F.col(NODES)

    def items(node: Column) -> Column:
        direct = F.filter(H.subtree(nodes, node), lambda n: (n["tag"] == "li") & (n["parent"] == node["pre"]))
        texts = F.transform(direct, lambda li: H.stripped_text(H.subtree(nodes, li), pruned=pruned))
        return F.filter(texts, lambda t: t != "")

    lists = F.transform(
        H.elements(nodes, "ul", "ol", pruned=pruned),
        lambda n: F.struct(
            F.when(n["tag"] == "ol", "ordered").otherwise("unordered").alias("type"),
            items(n).alias("items"),
        ),
    )
    full = F.filter(lists, lambda found: F.size(found["items"]) > 0)
    return parsed.select(page, F.posexplode(full).alias("list_idx", "l")).select(page, "list_idx", "l.*")


def page_key_values(parsed: DataFrame, page: str = "page_id") -> DataFrame:
    """One value per page and key, with where it came from.

    Terms of definition lists come first, then two-cell table rows; of these
    the last value of a key counts. ``Label: value`` in the text only adds
    keys not found yet, and there the first counts.
    """
    nodes = F.col(NODES)

    def text(node: Column) -> Column:
        return H.stripped_text(H.subtree(nodes, node), pruned=True)

    def pair(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    terms = F.flatten(
        F.transform(
            H.elements(nodes, "dl", pruned=True),
            lambda dl: F.filter(
                F.zip_with(
                    H.elements(H.subtree(nodes, dl), "dt"),
                    H.elements(H.subtree(nodes, dl), "dd"),
                    lambda dt, dd: F.when(dt.isNotNull() & dd.isNotNull(), pair(text(dt), text(dd))),
                ),
                lambda p: p.isNotNull(),
            ),
        )
    )
    rows = F.transform(
        F.filter(H.elements(nodes, "tr", pruned=True), lambda r: r["owner"] >= 0),
        lambda r: H.elements(H.subtree(nodes, r), "td", "th"),
    )
    two = F.filter(rows, lambda cells: F.size(cells) == 2)
    cells = F.transform(two, lambda cs: pair(text(F.get(cs, F.lit(0))), text(F.get(cs, F.lit(1)))))
    cells = F.filter(cells, lambda p: F.length(p["key"]) < V.KEY_MAX_LENGTH)
    raw = H.raw_text(nodes, pruned=True)
    labels = F.zip_with(
        all_matches(raw, UNICODE + V.KEY_VALUE, 1),
        all_matches(raw, UNICODE + V.KEY_VALUE, 2),
        lambda k, v: pair(strip(k), strip(v)),
    )
    labels = F.filter(labels, lambda p: F.length(p["key"]) < V.KEY_MAX_LENGTH)

    def listed(pairs: Column, source: str) -> Column:
        full = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
        return F.transform(full, lambda p: F.struct(p["key"], p["value"], F.lit(source).alias("source")))

    # In order of preference; the first of a key stays. All within the page's row.
    every = F.concat(F.reverse(listed(cells, "table")), F.reverse(listed(terms, "definition")), listed(labels, "label"))
    found = parsed.select(page, every.alias("__found"))
    keys = F.transform("__found", lambda p: p["key"])
    first = F.filter("__found", lambda p, i: F.array_position(F.col("__keys"), p["key"]) == i + 1)
    return found.withColumn("__keys", keys).select(page, F.inline(first))


def page_links(parsed: DataFrame, page: str = "page_id") -> DataFrame:
    """Target and text of every link, in document order."""
    nodes = F.col(NODES)
    links = F.transform(
        F.filter(H.elements(nodes, "a"), lambda a: F.map_contains_key(a["attrs"], "href")),
        lambda a: F.struct(a["attrs"]["href"].alias("href"), H.rendered_text(H.subtree(nodes, a)).alias("text")),
    )
    others = [c for c in parsed.columns if c not in (page, NODES, "html")]
    return parsed.select(page, *others, F.posexplode(links).alias("pos", "l")).select(page, *others, "pos", "l.*")


def page_media(parsed: DataFrame, page: str = "page_id") -> DataFrame:
    """Sources of audio and video elements, in document order."""
    found = F.transform(
        F.filter(
            H.elements(F.col(NODES), "audio", "video", "source"), lambda m: F.map_contains_key(m["attrs"], "src")
        ),
        lambda m: m["attrs"]["src"],
    )
    others = [c for c in parsed.columns if c not in (page, NODES, "html")]
    return parsed.select(page, *others, F.posexplode(found).alias("pos", "src"))


def _first_text(nodes: Column, match) -> Column:
    first = F.get(F.filter(nodes, match), F.lit(0))
    return F.when(first.isNotNull(), H.rendered_text(H.subtree(nodes, first)))


def value_by_id(element_id: str) -> Column:
    """Text of the first element with an id, as a column over parsed pages."""
    return _first_text(F.col(NODES), lambda n: n["attrs"]["id"] == element_id)


def page_value_by_id(parsed: DataFrame, element_id: str, page: str = "page_id") -> DataFrame:
    """Text of the first element with an id, null where a page has none."""
    return parsed.select(page, value_by_id(element_id).alias("value"))


def page_main_content(parsed: DataFrame, page: str = "page_id") -> DataFrame:
    """Text of the first main container with enough of it, else of the whole page."""
    nodes = F.col(NODES)
    choices = []
    for selector in V.MAIN_CONTENT:
        text = _first_text(nodes, _simple_match(selector))
        choices.append(
            F.struct(
                F.when(F.length(text) > V.MAIN_CONTENT_MIN_LENGTH, text).alias("text"), F.lit(selector).alias("selector")
            )
        )
    fit = F.filter(F.array(*choices), lambda c: c["text"].isNotNull())
    whole = F.struct(H.rendered_text(nodes).alias("text"), F.lit("page").alias("selector"))
    return parsed.select(page, F.coalesce(F.get(fit, F.lit(0)), whole).alias("m")).select(page, "m.*")


_SIMPLE = re.compile(
    r"""([.#][\w-]+)|\[\s*([\w-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\]\s"']+)\s*)?\]|(^[A-Za-z][\w-]*|^\*)"""
)


def _simple_match(selector: str):
    """Test for one simple selector: tag, ``.class``, ``#id``, ``[attr]``, ``[attr=value]`` together."""
    tests = []
    at = 0
    while at < len(selector):
        found = _SIMPLE.match(selector, at)
        if not found:
            raise ValueError(f"selector not supported: {selector!r}")
        at = found.end()
        mark, attr, value, tag = found.groups()
        if tag and tag != "*":
            tests.append(lambda n, t=tag.lower(): n["tag"] == t)
        elif mark and mark[0] == "#":
            tests.append(lambda n, v=mark[1:]: n["attrs"]["id"] == v)
        elif mark:
            tests.append(lambda n, v=mark[1:]: F.array_contains(F.split(n["attrs"]["class"], r"\s+"), v))
        elif attr and value is not None:
            tests.append(lambda n, a=attr.lower(), v=value.strip("\"'"): n["attrs"][a] == v)
        elif attr:
            tests.append(lambda n, a=attr.lower(): F.map_contains_key(n["attrs"], a))

    def match(node: Column) -> Column:
        ok = node["tag"] != "#text"
        for test in tests:
            ok = ok & F.coalesce(test(node), F.lit(False))
        return ok

    return match


def _step(match, outer: Column | None, child: bool, pruned: bool):
    """Test for a node that matches and lies inside (or directly inside) one found before."""

    def test(n: Column) -> Column:
        ok = match(n) & (~n["pruned"] if pruned else F.lit(True))
        if outer is None:
            return ok
        if child:
            return ok & F.exists(outer, lambda o: o["pre"] == n["parent"])
        return ok & F.exists(outer, lambda o: (o["pre"] < n["pre"]) & (n["pre"] <= o["last"]))

    return test


def css_values(selector: str, attribute: str = "text", pruned: bool = False) -> Column:
    """Text or an attribute of the elements a selector picks, as an array column over parsed pages.

    Simple selectors joined by a blank (inside) or ``>`` (directly inside).
    Anything else raises ValueError.
    """
    steps = re.findall(r"(>)|((?:\[[^\]]*\]|[^\s>\[])+)", selector.strip())
    nodes = F.col(NODES)
    tests, direct = [], False
    for arrow, simple in steps:
        if arrow:
            if not tests or direct:
                raise ValueError(f"selector not supported: {selector!r}")
            direct = True
            continue
        tests.append((_simple_match(simple), direct))
        direct = False
    if not tests or direct:
        raise ValueError(f"selector not supported: {selector!r}")

    def picked(outer: Column | None, left: list) -> Column:
        """The elements that pass the tests left; those of each step are found once a page, not once for every node tried against them."""
        (match, child), *rest = left
        found = F.filter(nodes, _step(match, outer, child, pruned))
        return _bound(found, lambda inner: picked(inner, rest)) if rest else found

    found = picked(None, tests)
    if attribute == "text":
        return F.transform(found, lambda n: H.stripped_text(H.subtree(nodes, n), pruned=pruned))
    return F.transform(found, lambda n: n["attrs"][attribute])


def css_select(
    parsed: DataFrame,
    selector: str,
    attribute: str = "text",
    multiple: bool = True,
    pruned: bool = False,
    page: str = "page_id",
) -> DataFrame:
    """Rows of what a selector picks; with ``multiple`` false the first per page, or null."""
    values = css_values(selector, attribute, pruned)
    if multiple:
        return parsed.select(page, F.posexplode(values).alias("pos", "value"))
    return parsed.select(page, F.get(values, F.lit(0)).alias("value"))


def css_parts(parsed: DataFrame, parts: dict[str, Column], first: Collection[str] = (), page: str = "page_id") -> DataFrame:
    """Rows (page, part, pos, value) of several ``css_values`` from one parse of each page.

    Of the parts in ``first`` the first value per page, or null, without its place.
    """
    values = {n: F.array(F.get(v, F.lit(0))) if n in first else v for n, v in parts.items()}
    each = F.array(*[F.struct(F.lit(n).alias("part"), v.alias("values")) for n, v in values.items()])
    listed = parsed.select(page, F.explode(each).alias("p")).select(page, "p.part", F.posexplode("p.values").alias("pos", "value"))
    return listed.withColumn("pos", F.when(~F.col("part").isin(*first), F.col("pos"))) if first else listed


def resolve_urls(df: DataFrame, base: str, ref: str, into: str = "resolved") -> DataFrame:
    """Adds the references of a column made absolute against another column."""
    return df.withColumn(into, resolve_url(F.col(base), F.col(ref)))


def data_links(links: DataFrame, base: str = "url", page: str = "page_id") -> DataFrame:
    """Links to data files, absolute, each once per page (pages with the same id count as one)."""
    files = links.where((F.col("href") != "") & is_data_link(F.col("href")))
    resolved = files.select(page, "pos", resolve_url(F.col(base), F.col("href")).alias("data_url"))
    return resolved.groupBy(page, "data_url").agg(F.min("pos").alias("pos"))


def page_data_links(parsed: DataFrame, base: str = "url", page: str = "page_id") -> DataFrame:
    """The same straight from parsed pages, each row by itself: no shuffle."""
    links = F.transform(
        F.filter(H.elements(F.col(NODES), "a"), lambda a: F.map_contains_key(a["attrs"], "href")),
        lambda a, i: F.struct(i.alias("pos"), a["attrs"]["href"].alias("href")),
    )
    files = F.filter(links, lambda x: (x["href"] != "") & is_data_link(x["href"]))
    listed = parsed.select(page, F.transform(files, lambda x: F.struct(x["pos"], resolve_url(F.col(base), x["href"]).alias("data_url"))).alias("__links"))
    urls = F.transform("__links", lambda x: x["data_url"])
    first = F.filter("__links", lambda x, i: F.array_position(F.col("__urls"), x["data_url"]) == i + 1)
    return listed.withColumn("__urls", urls).select(page, F.inline(first))


def link_edges(links: DataFrame, base: str = "url") -> DataFrame:
    """Host to host edges with the number of links."""
    return (
        links.select(
            host(F.col(base)).alias("src_host"),
            host(resolve_url(F.col(base), F.col("href"))).alias("dst_host"),
        )
        .where("src_host != '' AND dst_host != ''")
        .groupBy("src_host", "dst_host")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def link_graph(links: DataFrame, base: str = "url") -> DataFrame:
    """Links out of and into each host."""
    edges = link_edges(links, base)
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src_host").alias("host"), F.col("links").alias("o"), F.lit(0).cast("bigint").alias("i")),
                F.struct(F.col("dst_host").alias("host"), F.lit(0).cast("bigint").alias("o"), F.col("links").alias("i")),
            )
        ).alias("e")
    )
    return ends.groupBy(F.col("e.host").alias("host")).agg(
        F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree")
    )
