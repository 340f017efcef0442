"""Queries over page corpora: the given pages and pages made from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions.decode import decode_layers
from answerloom.functions.urls import default_submit_url, resolve_url, source_kind
from answerloom.operators import pages as P
from catalog import query, table, wide_table
from catalog.derived import TABLE_PAGES, derived


def _pages(spark, sf_dir, fields=None):
    return P.parse_pages(table(spark, sf_dir, "pages"), fields=fields)


def _table_pages(spark, sf_dir, fields=None):
    return P.parse_pages(derived(spark, sf_dir, TABLE_PAGES), fields=fields)


@query(
    "H0_shred_html",
    r"""
SELECT page_id, CAST(generate_subscripts(tags, 1) - 1 AS INT) AS place, unnest(tags) AS tag,
  replace(regexp_extract(unnest(rest), 'href="([^"]*)"', 1), '&amp;', '&') AS href, true AS nested
FROM (SELECT page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)((?: [^>]*)?)>', 1) AS tags,
  regexp_extract_all(html, '<([a-z][a-z0-9]*)((?: [^>]*)?)>', 2) AS rest FROM pages)
""",
)
def h0(spark, sf_dir):
    """The elements of every page in document order; ``nested`` tells that pre, last, level and parent agree with the element around."""
    nodes = F.col(P.NODES)

    def fits(n):
        up = F.get(nodes, n["parent"])
        inside = (up["pre"] < n["pre"]) & (n["last"] <= up["last"]) & (up["level"] + 1 == n["level"]) & (up["tag"] != "#text")
        return (n["last"] >= n["pre"]) & F.when(n["parent"] < 0, n["level"] == 0).otherwise(inside)

    kept = F.filter(nodes, lambda n: n["tag"] != "#text")
    told = F.transform(kept, lambda n: F.struct(n["tag"].alias("tag"), F.coalesce(n["attrs"]["href"], F.lit("")).alias("href"), fits(n).alias("nested")))
    return _pages(spark, sf_dir).select("page_id", F.posexplode(told).alias("place", "e")).select("page_id", "place", "e.*")


@query(
    "H0_tag_counts",
    """
SELECT tag, count(*) AS elements, count(DISTINCT page_id) AS pages FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY tag
""",
)
def h0_tags(spark, sf_dir):
    nodes = P.shred_html(_pages(spark, sf_dir)).where("tag != '#text'")
    return nodes.groupBy("tag").agg(
        F.count(F.lit(1)).alias("elements"), F.count_distinct("page_id").alias("pages")
    )


# The pages hold no other entities in their text; a cut-off title may end in one without its semicolon.
_ENTITIES = "regexp_replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;?', '&', 'g')"
_DROPPED = "script|style|noscript|header|footer|nav|aside"
_NO_BLOCKS = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
for _tag in _DROPPED.split("|"):
    _NO_BLOCKS = f"regexp_replace({_NO_BLOCKS}, '<{_tag}\\b.*?</{_tag}>', chr(1), 'gs')"
_TEXT = f"""array_to_string(list_filter(list_transform(
  string_split(regexp_replace({_NO_BLOCKS}, '<[^>]*>|' || chr(1), chr(2), 'g'), chr(2)),
  lambda x: trim({_ENTITIES.format("x")}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> ''), chr(10))"""


@query("H1_page_text", f"SELECT page_id, length(t) AS characters, md5(t) AS text_md5 FROM (SELECT page_id, {_TEXT} AS t FROM pages)")
def h1(spark, sf_dir):
    text = P.page_text(_pages(spark, sf_dir))
    return text.select("page_id", F.length("text").cast("bigint").alias("characters"), F.md5("text").alias("text_md5"))


def _cells(*cells) -> str:
    return " UNION ALL ".join(
        f"SELECT c_custkey AS page_id, {t} AS table_idx, {r} AS row_idx, {c} AS col_idx, {str(h).lower()} AS is_header,"
        f" {x} AS text FROM customer"
        for t, r, c, h, x in cells
    )


_ID = "CAST(c_custkey AS VARCHAR)"


@query(
    "H2_page_tables",
    _cells(
        (0, 0, 0, True, "'Name'"),
        (0, 0, 1, True, "'Balance'"),
        (0, 0, 2, True, "'Balance'"),
        (0, 1, 0, False, "c_name"),
        (0, 1, 1, False, _ID),
        (0, 1, 2, False, "'a & b'"),
        (0, 2, 0, False, "c_name"),
        (0, 2, 1, False, "'Segment'"),
        (0, 2, 2, False, "c_mktsegment"),
        (1, 0, 0, False, "'Key' || CAST(c_custkey % 3 AS VARCHAR)"),
        (1, 0, 1, False, f"'v' || {_ID}"),
        (1, 1, 0, False, "'Segment'"),
        (1, 1, 1, False, "c_mktsegment"),
    ),
)
def h2(spark, sf_dir):
    return P.page_tables(_table_pages(spark, sf_dir))


def _named(*cells) -> str:
    return " UNION ALL ".join(
        f"SELECT c_custkey AS page_id, {t} AS table_idx, {r} AS \"row\", {c} AS col_idx, {n} AS name, {x} AS value FROM customer"
        for t, r, c, n, x in cells
    )


@query(
    "C5_promote_cells",
    _named(
        (0, 0, 0, "'Name'", "c_name"),
        (0, 0, 1, "'Balance'", _ID),
        (0, 0, 2, "'Balance'", "'a & b'"),
        (0, 1, 0, "'Name'", "c_name"),
        (0, 1, 1, "'Balance'", "'Segment'"),
        (0, 1, 2, "'Balance'", "c_mktsegment"),
        (1, 0, 0, "'Key' || CAST(c_custkey % 3 AS VARCHAR)", "'Segment'"),
        (1, 0, 1, f"'v' || {_ID}", "c_mktsegment"),
    ),
)
def c5_cells(spark, sf_dir):
    return P.page_named_cells(_table_pages(spark, sf_dir))


@query(
    "H3_page_lists",
    f"""
SELECT c_custkey AS page_id, 0 AS list_idx, 'unordered' AS type, 'one|two' || {_ID} AS items FROM customer
UNION ALL SELECT c_custkey, 1, 'ordered', c_mktsegment || 'inner' FROM customer
UNION ALL SELECT c_custkey, 2, 'unordered', 'inner' FROM customer
""",
)
def h3(spark, sf_dir):
    lists = P.page_lists(_table_pages(spark, sf_dir))
    return lists.withColumn("items", F.array_join("items", "|"))


@query(
    "H3_page_lists_unpruned",
    r"""
SELECT page_id, 'unordered' AS type, len(regexp_extract_all(html, '<li>')) AS n,
  array_to_string(list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1),
    lambda x: trim(replace(x, '&amp;', '&'))), '|') AS items
FROM pages
""",
)
def h3_unpruned(spark, sf_dir):
    lists = P.page_lists(_pages(spark, sf_dir), pruned=False)
    return lists.select(
        "page_id", "type", F.size("items").cast("bigint").alias("n"), F.array_join("items", "|").alias("items")
    )


def _pairs(*pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT c_custkey AS page_id, {k} AS key, {v} AS value, '{s}' AS source FROM customer" for k, v, s in pairs
    )


@query(
    "H4_page_key_values",
    _pairs(
        ("'Segment'", "c_mktsegment", "table"),
        ("'Name'", "'Balance'", "table"),
        ("'Key' || CAST(c_custkey % 3 AS VARCHAR)", f"'v' || {_ID}", "table"),
        ("'Nation'", "CAST(c_nationkey AS VARCHAR)", "definition"),
        ("'Customer'", "c_name", "label"),
        ("'Total'", f"{_ID} || ' units.'", "label"),
        ("'Price'", f"'$' || {_ID} || '.99 Owner'", "label"),
    ),
)
def h4(spark, sf_dir):
    return P.page_key_values(_table_pages(spark, sf_dir))


@query(
    "H5_page_links",
    r"""
SELECT page_id, CAST(generate_subscripts(hrefs, 1) - 1 AS INT) AS pos, replace(unnest(hrefs), '&amp;', '&') AS href,
  trim(replace(unnest(texts), '&amp;', '&')) AS text
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages)
""",
)
def h5(spark, sf_dir):
    return P.page_links(_pages(spark, sf_dir)).select("page_id", "pos", "href", "text")


@query(
    "H6_page_media",
    f"""
SELECT c_custkey AS page_id, 0 AS pos, '/s/' || {_ID} || '.mp3' AS src FROM customer
UNION ALL SELECT c_custkey, 1, 'v' || {_ID} || '.webm' FROM customer
""",
)
def h6(spark, sf_dir):
    return P.page_media(_table_pages(spark, sf_dir)).select("page_id", "pos", "src")


@query(
    "H7_page_value_by_id",
    f"""
SELECT c_custkey AS page_id, CAST(c_custkey % 100 AS VARCHAR) AS cutoff, 'Total: ' || {_ID} || ' units.' AS result
FROM customer
""",
)
def h7(spark, sf_dir):
    parsed = _table_pages(spark, sf_dir)
    values = parsed.select(
        "page_id",
        P.value_by_id("cutoff").alias("cutoff"),
        P.value_by_id("result").alias("result"),
    )
    return values


_BLOCKS = "<br>|</?(h1|p|article)>"
_ARTICLE = "regexp_extract(html, '<article>(.*?)</article>', 1, 's')"
_SHOWN = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  {_ENTITIES.format(f"regexp_replace(regexp_replace({_ARTICLE}, '{_BLOCKS}', chr(1), 'g'), '<[^>]*>', '', 'g')")},
  '[ \\t\\n\\r]+', ' ', 'g'), ' ?(' || chr(1) || ' ?)+', chr(1), 'g'), '^[ \\x01]+|[ \\x01]+$', '', 'g'), '\\x01', chr(10), 'g')"""


@query(
    "H8_page_main_content",
    f"""
SELECT page_id, 'article' AS selector, length(t) AS characters, md5(t) AS text_md5
FROM (SELECT page_id, {_SHOWN} AS t FROM pages)
""",
)
def h8(spark, sf_dir):
    main = P.page_main_content(_pages(spark, sf_dir))
    return main.select(
        "page_id", "selector", F.length("text").cast("bigint").alias("characters"), F.md5("text").alias("text_md5")
    )


@query(
    "H9_css_select",
    r"""
SELECT page_id, 'nav' AS part, CAST(generate_subscripts(hrefs, 1) - 1 AS INT) AS pos,
  replace(unnest(hrefs), '&amp;', '&') AS value
FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs FROM pages)
UNION ALL
SELECT page_id, 'ad', 0, replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '&amp;', '&') FROM pages
UNION ALL SELECT c_custkey, 'dd', 0, 'dl-' || c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'dd', 1, CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'data', NULL, '/x/' || CAST(c_custkey AS VARCHAR) || '.JSON' FROM customer
""",
)
def h9(spark, sf_dir):
    given = P.css_parts(_pages(spark, sf_dir, P.CSS_FIELDS), {"nav": P.css_values("nav > ul li a[href]", "href"), "ad": P.css_values("body div.ad")})
    data = P.css_values("a.data.big", "href")
    made = P.css_parts(_table_pages(spark, sf_dir, P.CSS_FIELDS), {"dd": P.css_values("dl > dd"), "data": data}, first=["data"])
    return given.unionByName(made)


@query(
    "H10_data_links",
    f"""
SELECT c_custkey AS page_id, 0 AS pos,
  'https://h' || c_nationkey || '.example.com/a/data/' || {_ID} || '.csv?y=2&z=3' AS data_url FROM customer
UNION ALL SELECT c_custkey, 1, 'https://h' || c_nationkey || '.example.com/x/' || {_ID} || '.JSON' FROM customer
UNION ALL SELECT c_custkey, 4, 'https://o.example.org/i.png#z' FROM customer
""",
)
def h10(spark, sf_dir):
    return P.page_data_links(_table_pages(spark, sf_dir))


_REFS = ["/top/x?q=1", "other.html", "../up.csv", "https://abs.example.org/z", "?only=query", "#frag", "//net.example/p",
         "./a/../b//c.json", "mailto:x@example.com", ""]
_HOST = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_SCHEME = "regexp_extract(url, '^(https?:)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_DIR = f"regexp_replace({_PATH}, '[^/]*$', '')"


@query(
    "H11_resolve_urls",
    f"""
SELECT page_id, unnest(range(10)) AS nr, unnest([
  {_HOST} || '/top/x?q=1', {_HOST} || {_DIR} || 'other.html',
  {_HOST} || regexp_replace({_DIR}, '[^/]+/$', '') || 'up.csv', 'https://abs.example.org/z',
  {_HOST} || {_PATH} || '?only=query',
  regexp_replace(url, '#.*$', '') || '#frag', {_SCHEME} || '//net.example/p',
  {_HOST} || {_DIR} || 'b/c.json', 'mailto:x@example.com', url]) AS resolved,
  {_HOST} || '/submit' AS submit
FROM pages
""",
)
def h11(spark, sf_dir):
    refs = F.array(*[F.lit(r) for r in _REFS])
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(refs).alias("nr", "ref"))
    return pages.select(
        "page_id",
        F.col("nr").cast("bigint").alias("nr"),
        resolve_url(F.col("url"), F.col("ref")).alias("resolved"),
        default_submit_url(F.col("url"), F.lit(None).cast("string")).alias("submit"),
    )


_EDGES = r"""
SELECT src_host, CASE WHEN starts_with(href, '/') THEN src_host ELSE lower(regexp_extract(href, '^https?://([^/?#]*)', 1)) END
  AS dst_host, count(*) AS links
FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS src_host,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages)
GROUP BY ALL
"""


@query(
    "H12_link_graph",
    f"""
SELECT host, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT src_host AS host, links AS o, 0 AS i FROM ({_EDGES}) UNION ALL SELECT dst_host, 0, links FROM ({_EDGES}))
GROUP BY host
""",
)
def h12(spark, sf_dir):
    return P.link_graph(P.page_links(_pages(spark, sf_dir)))


_TAIL = " 100% A+B %41%20z &amp;"


@query(
    "H13_decode_layers",
    f"""
SELECT doc_id, CAST(doc_id % 4 AS INT) AS layers, md5(text || ' 100% A+B A z &') AS text_md5
FROM documents
""",
)
def h13(spark, sf_dir):
    encoded = F.concat("text", F.lit(_TAIL))
    for layer in range(1, 4):
        encoded = F.when(F.col("doc_id") % 4 >= layer, F.base64(encoded)).otherwise(encoded)
    documents = wide_table(spark, sf_dir, "documents").select("doc_id", encoded.alias("encoded"))
    return decode_layers(documents, "encoded").select("doc_id", "layers", F.md5("text").alias("text_md5"))


_AUDIO = "mp3|wav|ogg|m4a|flac|aac|wma|opus"
_IMAGE = "png|jpg|jpeg|gif|webp|bmp|tiff"
_MADE_URL = (
    "concat(url, CASE page_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv' WHEN 2 THEN '.zip' WHEN 3 THEN '.MP3'"
    " WHEN 4 THEN '.jpeg' WHEN 5 THEN '/api/x' WHEN 6 THEN '/data' WHEN 7 THEN '.CSV' ELSE '' END)"
)


@query(
    "S1_route_sources",
    f"""
SELECT page_id, CASE WHEN ends_with(u, '.pdf') THEN 'pdf' WHEN ends_with(u, '.zip') THEN 'zip'
  WHEN regexp_matches(u, '\\.(csv|json|xlsx|xls|xml|txt)$') THEN 'file'
  WHEN regexp_matches(lower(u), '\\.({_AUDIO})$') THEN 'audio' WHEN regexp_matches(lower(u), '\\.({_IMAGE})$') THEN 'image'
  WHEN contains(u, '/api/') OR ends_with(u, '/data') THEN 'api' ELSE 'page' END AS kind
FROM (SELECT page_id, {_MADE_URL} AS u FROM pages UNION ALL SELECT page_id + 1000000000, url FROM pages)
""",
)
def s1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    made = pages.selectExpr("page_id", f"{_MADE_URL} AS u")
    plain = pages.select((F.col("page_id") + 1000000000).alias("page_id"), F.col("url").alias("u"))
    return made.unionByName(plain).select("page_id", source_kind(F.col("u")).alias("kind"))
