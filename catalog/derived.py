"""Inputs that are computed from the given tables.

Each is one SELECT over a given table, written in SQL that Spark and DuckDB read
alike, so that a query and the SQL checking it start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog import wide_table

_KEY = "cast(o_orderkey as string)"
_CUT = "cast(o_orderkey % 50 as string)"

QUESTIONS = f"""
SELECT o_orderkey AS qid, o_custkey AS user_key,
  CASE o_orderkey % 9
    WHEN 0 THEN concat('Q', {_KEY}, '. What is the sum of values greater than or equal to cutoff: ', {_CUT},
      '? Scrape /data/', {_KEY}, ' and POST it back to /submit . See https://h', {_CUT}, '.example.com/f', {_KEY}, '.csv.')
    WHEN 1 THEN concat('Q', {_KEY}, '. Add the values above Cutoff ', {_CUT}, '! Use <a href="/files/', {_KEY},
      '.json">this</a> and https://h', {_CUT}, '.example.com/Submit/', {_KEY}, ', or (https://h1.example.com/a.PDF).')
    WHEN 2 THEN concat('What is the total of the column on page ', {_CUT}, '? Visit /pages/', {_KEY},
      ' then visit /pages/', {_KEY}, ' again; submit it to /submit?id=', {_KEY}, ' now.')
    WHEN 3 THEN concat('Q', {_KEY}, ' How many rows are there? Get data from /api/', {_KEY},
      ' Answer at https://h', {_CUT}, '.example.com/answer/', {_KEY}, '!')
    WHEN 4 THEN concat('Discount list ', {_KEY}, ': what is the average, where the group by filter is ', {_CUT},
      '? Get from /list/', {_KEY}, ' , send back to /submit')
    WHEN 5 THEN concat('Draw a chart of the maximum, Q', {_KEY}, ', as base64. href=', chr(39), '/img/', {_KEY}, chr(39))
    WHEN 6 THEN concat('Give the lowest value in a JSON answer. CUTOFF VALUE is ', {_CUT}, ' , POST all to /submit/', {_KEY})
    WHEN 7 THEN concat('Summary ', {_KEY}, ' with count and counts: sum column total sum page sum ', {_CUT})
    ELSE concat('  What is the first cell of ', {_KEY}, '  ')
  END AS text
FROM orders
"""

ANSWERS = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'number' WHEN 2 THEN 'boolean'
    WHEN 3 THEN 'json' WHEN 4 THEN 'string' ELSE 'number' END AS format,
  CASE o_orderkey % 18
    WHEN 0 THEN concat(' The value is 1,', cast(o_orderkey % 900 + 100 as string), ',500 units ')
    WHEN 1 THEN concat('-', cast(o_orderkey as string), '.25 or 7')
    WHEN 2 THEN CASE WHEN o_orderkey % 36 = 2 THEN ' Yes' ELSE 'FALSE ' END
    WHEN 3 THEN concat('{"k": ', cast(o_orderkey as string), '}')
    WHEN 4 THEN concat('Answer: code ', cast(o_orderkey as string))
    WHEN 5 THEN 'no digits here'
    WHEN 6 THEN concat('```', chr(10), cast(o_orderkey as string), chr(10), '```')
    WHEN 7 THEN concat('```python', chr(10), '00', cast(o_orderkey as string), chr(10), 'x')
    WHEN 8 THEN concat('maybe ', cast(o_orderkey as string))
    WHEN 9 THEN concat('Here it is: [1, 2, ', cast(o_orderkey as string), '] as asked')
    WHEN 10 THEN concat('result:  the answer is: ', cast(o_orderkey as string))
    WHEN 11 THEN concat(cast(o_orderkey as string), '.5 %')
    WHEN 12 THEN concat('```', chr(10), 'x```')
    WHEN 13 THEN concat('= ', cast(o_orderkey as string), '.')
    WHEN 14 THEN 'no'
    WHEN 15 THEN concat('url = {broken ', cast(o_orderkey as string))
    WHEN 16 THEN concat('The answer is: git clone ', cast(o_orderkey as string))
    ELSE concat('about ', cast(o_orderkey as string), ' or so')
  END AS answer
FROM orders
"""

RESPONSES = """
SELECT o_orderkey AS id, o_custkey AS user_key, o_orderdate AS answered,
  CASE WHEN o_orderkey % 7 = 0 THEN 404 WHEN o_orderkey % 11 = 0 THEN 500 ELSE 200 END AS status,
  CASE
    WHEN o_orderkey % 7 = 0 THEN 'not found'
    WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN concat('{"correct": true, "url": "/q/', cast(o_orderkey as string), '"}')
    WHEN o_orderstatus = 'F' THEN '{"correct": false, "reason": "too low", "message": "again"}'
    WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'Your answer is Correct.'
    WHEN o_orderstatus = 'O' THEN 'That is incorrect'
    ELSE '{"reason": "no verdict"}'
  END AS body
FROM orders
"""

TREE = """
SELECT p_partkey AS id,
  concat(p_brand, '/', p_type, '/', replace(p_name, ' ', '_'),
    CASE p_partkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.MD' ELSE '.md.txt' END) AS path,
  CASE WHEN p_partkey % 5 = 0 THEN 'tree' ELSE 'blob' END AS type
FROM part
"""

EDGES = "SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000 AS dst FROM lineitem"

NEXT_LINKS = """
SELECT o_orderkey AS start,
  CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE (o_orderkey * 7 + 3) % (SELECT count(*) FROM orders) END AS next
FROM orders
"""

CUSTOMER_POINTS = """
SELECT c_custkey AS id, c_nationkey AS nation,
  cast((c_custkey * 7919) % 12000 as double) / 100.0 - 60.0 AS lat,
  cast((c_custkey * 104729) % 36000 as double) / 100.0 - 180.0 AS lon
FROM customer
"""

SUPPLIER_POINTS = """
SELECT s_suppkey AS id, s_nationkey AS nation,
  cast((s_suppkey * 6007) % 12000 as double) / 100.0 - 60.0 AS lat,
  cast((s_suppkey * 50021) % 36000 as double) / 100.0 - 180.0 AS lon
FROM supplier
"""

TOKENS = "SELECT event_id, user_id AS session, ts, cast(floor(value * 100) as bigint) AS tokens FROM events"


_C = "cast(c_custkey as string)"

TABLE_PAGES = f"""
SELECT c_custkey AS page_id,
  concat('https://h', cast(c_nationkey as string), '.example.com/a/b/', {_C}, '.html?x=1') AS url,
  concat('<!DOCTYPE html><html><head><title>T ', {_C}, '</title><style>td{{color:red}}</style>',
    '<script>var a = "<table><tr><td>no</td></tr></table>";</script></head><body>',
    '<nav><table><tr><td>skip</td><td>me</td></tr></table><ul><li>skip</li></ul></nav>',
    chr(10), '<h1>Customer: ', c_name, '</h1>', chr(10),
    '<table><tr><th>Name</th><th colspan="2">Balance</th></tr>', chr(10),
    '<tr><td rowspan="2">', c_name, '</td><td>', {_C}, '</td><td> a &amp;  <b>b</b> </td></tr>', chr(10),
    '<tr><td>Segment</td><td>', c_mktsegment, '</td></tr></table>', chr(10),
    '<table><tr><td>Key', cast(c_custkey % 3 as string), '</td><td>v', {_C},
    '<tr><td>Segment<td>', c_mktsegment, '</table>', chr(10),
    '<ul><li> one </li><li><b>two</b> ', {_C}, '<li></ul><ol><li>', c_mktsegment,
    '<ul><li>inner</li></ul></li></ol><ul></ul>', chr(10),
    '<dl><dt>Segment</dt><dd>dl-', c_mktsegment, '</dd><dt>Nation<dd>', cast(c_nationkey as string), '<dt>Lonely</dl>',
    '<!-- <span id="cutoff">wrong</span> --><span id="cutoff">', cast(c_custkey % 100 as string), '</span>', chr(10),
    '<div id="result">Total: <b>', {_C}, '</b> units.</div>', chr(10),
    '<p>Price: $', {_C}, '.99 Owner: someone.</p>', chr(10), '<p>Price: 5</p>', chr(10),
    '<audio src="/s/', {_C}, '.mp3"></audio><video><source src="v', {_C}, '.webm"></video>',
    '<a href="../data/', {_C}, '.csv?y=2&amp;z=3">csv <i>file</i></a><a class="big data" href="/x/', {_C}, '.JSON">j</a>',
    '<a name="n">no</a><a href="/x/', {_C}, '.JSON"> again </a><a href="page">p</a>',
    '<a href="https://o.example.org/i.png#z">img</a>', CASE WHEN c_custkey % 2 = 0 THEN '</body></html>' ELSE '' END
  ) AS html
FROM customer
"""


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the SELECTs above over the given tables."""
    for name in ("orders", "customer", "supplier", "part", "lineitem", "events"):
        if f"FROM {name}" in sql:
            wide_table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)
