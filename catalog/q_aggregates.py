"""Aggregation and analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions import answers as A
from answerloom.functions import questions as Q
from answerloom.operators import aggregates as G
from catalog import query, table, wide_table
from catalog.derived import QUESTIONS, derived

_CUTS = rf"""
SELECT qid, user_key, text,
  CAST(coalesce(nullif(regexp_extract(text, 'cutoff[:\s]+(\d+)', 1, 'i'), ''),
    nullif(regexp_extract(text, 'CUTOFF VALUE[^\d]*(\d+)', 1), '')) AS BIGINT) AS cutoff,
  contains(lower(text), 'greater than or equal') OR contains(text, '>=') AS inclusive
FROM ({QUESTIONS})
"""
_CUT_SUMS = f"""
cuts AS ({_CUTS}),
marks AS (SELECT DISTINCT cutoff, inclusive FROM cuts WHERE cutoff IS NOT NULL),
sums AS (SELECT cutoff, inclusive, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS answer
  FROM marks LEFT JOIN lineitem ON (inclusive AND l_quantity >= cutoff) OR (NOT inclusive AND l_quantity > cutoff)
  GROUP BY ALL)
"""


def _cut_questions(spark, sf_dir):
    return derived(spark, sf_dir, QUESTIONS).select(
        "*",
        Q.cutoff(F.col("text")).alias("cutoff"),
        Q.cutoff_inclusive(F.col("text")).alias("inclusive"),
    )


@query("A1_parse_cutoff", f"SELECT qid, cutoff, inclusive FROM ({_CUTS})")
def a1(spark, sf_dir):
    return _cut_questions(spark, sf_dir).select("qid", "cutoff", "inclusive")


@query(
    "A2_cutoff_sum",
    "SELECT CAST(coalesce(sum(l_extendedprice), 0) AS BIGINT) - 0 AS answer FROM "
    "(SELECT trunc(sum(l_extendedprice)) AS l_extendedprice FROM lineitem WHERE l_extendedprice >= 50000)",
)
def a2(spark, sf_dir):
    return G.cutoff_sum(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50000, True)


@query(
    "A3_cutoff_sums",
    f"WITH {_CUT_SUMS} SELECT qid, cuts.cutoff, cuts.inclusive, answer FROM cuts LEFT JOIN sums USING (cutoff, inclusive)",
)
def a3(spark, sf_dir):
    asked = _cut_questions(spark, sf_dir).select("qid", "cutoff", "inclusive")
    return G.cutoff_sums(asked, table(spark, sf_dir, "lineitem"), "l_quantity")


@query("A4_column_sum", "SELECT round(sum(l_extendedprice), 2) AS answer FROM lineitem")
def a4(spark, sf_dir):
    found = G.column_sum(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return found.select(F.round("answer", 2).alias("answer"))


@query("A5_row_count", "SELECT count(*) AS answer FROM lineitem")
def a5(spark, sf_dir):
    return G.row_count(table(spark, sf_dir, "lineitem"))


@query("A6_column_mean", "SELECT round(avg(l_discount), 8) AS answer FROM lineitem")
def a6(spark, sf_dir):
    found = G.column_mean(table(spark, sf_dir, "lineitem"), "l_discount")
    return found.select(F.round("answer", 8).alias("answer"))


@query("A7_column_max", "SELECT max(o_totalprice) AS answer FROM orders")
def a7_max(spark, sf_dir):
    return G.column_max(table(spark, sf_dir, "orders"), "o_totalprice")


@query("A7_column_min", "SELECT min(o_totalprice) AS answer FROM orders")
def a7_min(spark, sf_dir):
    return G.column_min(table(spark, sf_dir, "orders"), "o_totalprice")


@query("A8_first_value", "SELECT event_type AS answer FROM events ORDER BY ts, event_id LIMIT 1")
def a8(spark, sf_dir):
    return G.first_value(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"])


def _words(*words: str) -> str:
    return "regexp_matches(text, '\\b(" + "|".join(words) + ")\\b', 'i')"


# Two numeric columns, one of whole numbers, one with NaN and nulls, and a text column; every third question names a column.
STOCK = """
SELECT concat('line ', cast(l_linenumber as string)) AS label, l_partkey AS pieces,
  CASE WHEN l_partkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS weight, l_orderkey, l_linenumber
FROM lineitem
"""
_NAMED = f"""
SELECT qid, user_key, CASE qid % 3 WHEN 0 THEN concat(text, ' Use the weight column.') WHEN 1 THEN concat(text, ' (Weightless PIECES.)') ELSE text END AS text
FROM ({QUESTIONS})
"""
A9_ANSWERS = f"""
stock AS (SELECT label, pieces, CASE WHEN isnan(weight) THEN NULL ELSE weight END AS weight, l_orderkey, l_linenumber FROM ({STOCK})),
named AS (SELECT *, regexp_matches(text, '\\bweight\\b', 'i') AND NOT regexp_matches(text, '\\bpieces\\b', 'i') AS by_weight FROM ({_NAMED})),
cuts AS (SELECT *,
  CAST(coalesce(nullif(regexp_extract(text, 'cutoff[:\\s]+(\\d+)', 1, 'i'), ''),
    nullif(regexp_extract(text, 'CUTOFF VALUE[^\\d]*(\\d+)', 1), '')) AS BIGINT) AS cutoff,
  contains(lower(text), 'greater than or equal') OR contains(text, '>=') AS inclusive FROM named),
marks AS (SELECT DISTINCT by_weight, cutoff, inclusive FROM cuts WHERE cutoff IS NOT NULL),
sums AS (SELECT by_weight, cutoff, inclusive, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM marks LEFT JOIN
  (SELECT true AS w, weight AS v FROM stock UNION ALL SELECT false, pieces FROM stock)
  ON w = by_weight AND ((inclusive AND v >= cutoff) OR (NOT inclusive AND v > cutoff)) GROUP BY ALL),
plain AS (
  SELECT true AS w, sum(weight) AS s, avg(weight) AS a, max(weight) AS hi, min(weight) AS lo, count(*) AS n FROM stock
  UNION ALL SELECT false, CAST(sum(pieces) AS DOUBLE), avg(pieces), CAST(max(pieces) AS DOUBLE), CAST(min(pieces) AS DOUBLE), count(*) FROM stock),
asked AS (SELECT *, CASE
  WHEN {_words("sum", "add")} AND cutoff IS NOT NULL THEN 'cutoff_sum'
  WHEN {_words("sum", "total")} THEN 'sum'
  WHEN {_words("count", "how many")} THEN 'count'
  WHEN {_words("average", "mean")} THEN 'mean'
  WHEN {_words("max", "maximum", "highest")} THEN 'max'
  WHEN {_words("min", "minimum", "lowest")} THEN 'min'
  ELSE 'first' END AS metric FROM cuts),
answered AS (SELECT qid, user_key, text, metric, CASE WHEN by_weight THEN 'weight' ELSE 'pieces' END AS "column",
  CASE metric WHEN 'cutoff_sum' THEN CAST(total AS DOUBLE) WHEN 'sum' THEN s WHEN 'count' THEN n
    WHEN 'mean' THEN a WHEN 'max' THEN hi WHEN 'min' THEN lo END AS answer,
  CASE WHEN metric = 'first' THEN (SELECT min_by(label, {{'k': l_orderkey, 'n': l_linenumber, 'p': pieces}}) FROM stock)
    WHEN metric = 'count' THEN CAST(n AS VARCHAR) WHEN metric = 'cutoff_sum' THEN CAST(total AS VARCHAR)
    WHEN metric = 'sum' AND NOT by_weight THEN CAST((SELECT CAST(sum(pieces) AS BIGINT) FROM stock) AS VARCHAR) END AS exact
FROM asked LEFT JOIN sums USING (by_weight, cutoff, inclusive) JOIN plain ON w = by_weight)
"""


def stock_answers(spark, sf_dir):
    """All questions answered over a table of two numeric columns and a text column."""
    asked = derived(spark, sf_dir, _NAMED).select("qid", "user_key", "text")
    stock = derived(spark, sf_dir, STOCK).select("label", "pieces", "weight", "l_orderkey", "l_linenumber")
    questions = stock.select("label", "pieces", "weight", F.struct("l_orderkey", "l_linenumber", "pieces").alias("at"))
    return G.answer_questions(asked, questions, ["at"])


@query("A9_answer_questions", f"WITH {A9_ANSWERS} SELECT qid, metric, \"column\", round(answer, 6) AS answer, exact FROM answered")
def a9(spark, sf_dir):
    exact = F.col("metric").isin("first", "count", "cutoff_sum") | ((F.col("metric") == "sum") & (F.col("column") == "pieces"))
    return stock_answers(spark, sf_dir).select(
        "qid", "metric", "column", F.round("answer", 6).alias("answer"), F.when(exact, F.col("answer_text")).alias("exact")
    )


@query(
    "A10_group_aggregate",
    """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(avg(l_discount), 8) AS avg_disc,
  count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""",
)
def a10(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return G.group_aggregate(
        lineitem,
        ["l_returnflag", "l_linestatus"],
        {
            "sum_qty": F.sum("l_quantity"),
            "sum_base_price": F.round(F.sum("l_extendedprice"), 2),
            "sum_disc_price": F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4),
            "avg_disc": F.round(F.avg("l_discount"), 8),
            "count_order": F.count(F.lit(1)),
        },
    )


@query(
    "A11_filter_aggregate",
    """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue, count(*) AS n FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01'
  AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
""",
)
def a11(spark, sf_dir):
    condition = F.expr(
        "l_shipdate >= TIMESTAMP_NTZ '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1995-01-01 00:00:00'"
        " AND l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24"
    )
    return G.filter_aggregate(
        table(spark, sf_dir, "lineitem"),
        condition,
        {
            "revenue": F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4),
            "n": F.count(F.lit(1)),
        },
    )


@query(
    "A12_share",
    """
SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS part,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 8) AS ratio,
  round(100 * sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END)
    / (SELECT sum(o_totalprice) FROM orders), 8) AS percentage
FROM orders GROUP BY o_orderpriority
""",
)
def a12(spark, sf_dir):
    shares = G.share(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", "o_totalprice")
    return shares.select(
        "o_orderpriority",
        F.round("part", 2).alias("part"),
        F.round("ratio", 8).alias("ratio"),
        F.round("percentage", 8).alias("percentage"),
    )


_STATS = ("mean", "stddev", "q1", "median", "q3", "correlation")


@query(
    "A13_statistics",
    """
SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean,
  round(stddev_samp(l_extendedprice), 4) AS stddev, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum,
  round(corr(l_extendedprice, l_quantity), 8) AS correlation,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS q3
FROM lineitem GROUP BY l_returnflag
""",
)
def a13(spark, sf_dir):
    stats = G.statistics(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return stats.select(
        *[F.round(c, 8 if c == "correlation" else 4).alias(c) if c in _STATS else F.col(c) for c in stats.columns]
    )


@query(
    "A14_distinct_count",
    "SELECT count(DISTINCT l_partkey) AS l_partkey_distinct, count(DISTINCT l_suppkey) AS l_suppkey_distinct FROM lineitem",
)
def a14(spark, sf_dir):
    return G.distinct_count(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("A14_value_frequencies", "SELECT event_type, count(*) AS frequency FROM events GROUP BY event_type")
def a14_values(spark, sf_dir):
    return G.value_frequencies(table(spark, sf_dir, "events"), "event_type")


_RULE = """CASE c_custkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'email_length_mod_2' WHEN 2 THEN 'email_length_mod_3'
  WHEN 3 THEN 'length mod 5' WHEN 4 THEN 'email_checksum' WHEN 5 THEN 'length_mod_20' ELSE 'other' END"""
_OFFSET = """CASE c_custkey % 7 WHEN 1 THEN length(c_name) % 2 WHEN 2 THEN length(c_name) % 3 WHEN 3 THEN length(c_name) % 5
  WHEN 4 THEN CAST(list_sum(list_transform(string_split(c_name, ''), lambda x: unicode(x))) % 100 AS BIGINT)
  WHEN 5 THEN length(c_name) % 20 ELSE 0 END"""


def _offsets(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .selectExpr("c_custkey", "c_name", f"{_RULE} AS rule")
        .withColumn("offset", A.personal_offset(F.col("c_name"), F.col("rule")))
    )


@query("A15_personal_offset", f'SELECT c_custkey, CAST({_OFFSET} AS BIGINT) AS "offset" FROM customer')
def a15(spark, sf_dir):
    return _offsets(spark, sf_dir).select("c_custkey", "offset")


@query(
    "A16_apply_offset",
    f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0
    THEN o_totalprice + CAST(coalesce("offset", 0) AS DOUBLE) ELSE o_totalprice END AS answer
FROM orders LEFT JOIN (SELECT c_custkey, {_OFFSET} AS "offset" FROM customer) ON o_custkey = c_custkey
""",
)
def a16(spark, sf_dir):
    answers = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("answer"),
        (F.col("o_orderkey") % 3 != 0).alias("personalised"),
    )
    moved = G.apply_offset(answers, _offsets(spark, sf_dir), "c_custkey", "answer", "rule", "personalised")
    return moved.select("o_orderkey", "answer")


@query(
    "A17_hash_columns",
    """
SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256,
  substring(md5(source || '-' || CAST(doc_id AS VARCHAR)), 1, 12) AS short_id
FROM documents
""",
)
def a17(spark, sf_dir):
    md5, sha1, sha256, _ = G.hash_columns(F.col("text"))
    return wide_table(spark, sf_dir, "documents").select(
        "doc_id", md5, sha1, sha256, A.short_id(F.col("source"), F.col("doc_id")).alias("short_id")
    )
