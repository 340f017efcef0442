"""Queries that clean, type, profile and merge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.operators import prepare as P
from answerloom.sources.sinks import to_json_records
from catalog import query, table, wide_table
from catalog.derived import TREE, derived

_DIRTY = {
    " Cust  Key ": "cast(c_custkey as string)",
    "Acct Bal": "CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '' ELSE cast(c_nationkey as string) END",
    "acct  bal": "CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE cast(c_nationkey as string) END",
    "SEGMENT": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END",
    "Since": "concat('2024-01-', CASE WHEN c_custkey % 28 < 9 THEN '0' ELSE '' END, cast(c_custkey % 28 + 1 as string))",
    "Balance": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END",
}


def _dirty(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.select(*[F.expr(e).alias(n) for n, e in _DIRTY.items()])


def _clean_sql(names) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in zip(names, _DIRTY.values()))


_NAMES = ["cust_key", "acct_bal", "acct_bal_2", "segment", "since", "balance"]
_CLEAN = f"SELECT {_clean_sql(_NAMES)} FROM customer"


@query("C1_clean_column_names", _CLEAN)
def c1(spark, sf_dir):
    return P.clean_column_names(_dirty(spark, sf_dir))


@query(
    "C2_infer_types",
    f"""
SELECT CAST(cust_key AS DOUBLE) AS cust_key, CAST(nullif(acct_bal, '') AS DOUBLE) AS acct_bal, acct_bal_2, segment,
  CAST(since AS TIMESTAMP) AS since, balance FROM ({_CLEAN})
""",
)
def c2(spark, sf_dir):
    return P.infer_types(P.clean_column_names(_dirty(spark, sf_dir)))


@query(
    "C2_coerce_types",
    f"""
SELECT CAST(cust_key AS DOUBLE) AS cust_key, TRY_CAST(acct_bal AS DOUBLE) AS acct_bal,
  TRY_CAST(acct_bal_2 AS DOUBLE) AS acct_bal_2, CAST(NULL AS DOUBLE) AS segment, CAST(NULL AS DOUBLE) AS since, balance
FROM ({_CLEAN})
""",
)
def c2_coerce(spark, sf_dir):
    return P.infer_types(P.clean_column_names(_dirty(spark, sf_dir)), mode="coerce")


@query(
    "C3_missing_report",
    f"""
WITH d AS ({_CLEAN}), m AS (
{" UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS missing FROM d" for n in _NAMES)})
SELECT "column", missing, CAST((SELECT sum(missing) FROM m) AS BIGINT) AS total FROM m
""",
)
def c3(spark, sf_dir):
    return P.missing_report(P.clean_column_names(_dirty(spark, sf_dir)))


@query(
    "C3_fill_missing",
    f"""
SELECT coalesce(cust_key, '') AS cust_key, coalesce(acct_bal, '') AS acct_bal, coalesce(acct_bal_2, '') AS acct_bal_2,
  coalesce(segment, '') AS segment, coalesce(since, '') AS since, balance FROM ({_CLEAN})
""",
)
def c3_fill(spark, sf_dir):
    return P.fill_missing(P.clean_column_names(_dirty(spark, sf_dir)))


_PAYLOAD = """CASE event_id % 5
  WHEN 0 THEN props
  WHEN 1 THEN concat('[', props, ', {"k": "x"}]')
  WHEN 2 THEN concat('a,b', chr(10), cast(user_id as string), ',"p, q"', chr(10), cast(event_id as string), ',')
  WHEN 3 THEN '  '
  ELSE 'only a header' END"""
_ODD = """concat('a,a,b', chr(10), cast(user_id as string), ',"', chr(1), 'x', chr(2), chr(10), chr(3), '1",', cast(event_id as string))"""


@query(
    "C4_repeated_headers",
    "SELECT event_id, 'csv' AS kind, 0 AS pos, CAST(user_id AS VARCHAR) AS a, chr(1) || 'x' || chr(2) || chr(10) || chr(3) || '1' AS a_2,"
    " CAST(event_id AS VARCHAR) AS b FROM events",
)
def c4_odd(spark, sf_dir):
    """Repeated header names, and cells that hold control characters."""
    payloads = wide_table(spark, sf_dir, "events").selectExpr("event_id", f"{_ODD} AS payload")
    records = P.coerce_payloads(payloads, "payload")
    return records.select("event_id", "kind", "pos", *[F.try_element_at("record", F.lit(n)).alias(n) for n in ("a", "a_2", "b")])


@query(
    "C4_coerce_payloads",
    f"""
SELECT event_id, 'json' AS kind, 0 AS pos, json_extract_string(props, '$.k') AS k, NULL AS a, NULL AS b
FROM events WHERE event_id % 5 IN (0, 1)
UNION ALL SELECT event_id, 'json', 1, 'x', NULL, NULL FROM events WHERE event_id % 5 = 1
UNION ALL SELECT event_id, 'csv', 0, NULL, CAST(user_id AS VARCHAR), 'p, q' FROM events WHERE event_id % 5 = 2
UNION ALL SELECT event_id, 'csv', 1, NULL, CAST(event_id AS VARCHAR), NULL FROM events WHERE event_id % 5 = 2
UNION ALL SELECT event_id, 'rejected', NULL, NULL, NULL, NULL FROM events WHERE event_id % 5 > 2
""",
)
def c4(spark, sf_dir):
    payloads = wide_table(spark, sf_dir, "events").selectExpr("event_id", f"{_PAYLOAD} AS payload")
    records = P.coerce_payloads(payloads, "payload")
    return records.select(
        "event_id",
        "kind",
        "pos",
        *[F.try_element_at("record", F.lit(n)).alias(n) for n in ("k", "a", "b")],
    )


@query(
    "C5_promote_header",
    """
SELECT o_orderkey, 0 AS "row", c.col, c.name, c.value FROM (
  SELECT o_orderkey, unnest([
    {'col': 0, 'name': 'status', 'value': o_orderstatus},
    {'col': 1, 'name': 'priority', 'value': o_orderpriority}]) AS c FROM orders)
UNION ALL
SELECT o_orderkey, 1, c.col, c.name, c.value FROM (
  SELECT o_orderkey, unnest([
    {'col': 0, 'name': 'status', 'value': CAST(o_custkey AS VARCHAR)},
    {'col': 1, 'name': 'priority', 'value': NULL}]) AS c FROM orders)
""",
)
def c5(spark, sf_dir):
    cells = F.array(
        F.array(F.lit("status"), F.lit("priority")),
        F.array("o_orderstatus", "o_orderpriority"),
        F.array(F.col("o_custkey").cast("string")),
    )
    return P.promote_header(table(spark, sf_dir, "orders").select("o_orderkey", cells.alias("cells")), "cells")


def _profile_sql(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS missing,"
        f' count(DISTINCT {c}) AS "distinct", CAST(min({c}) AS VARCHAR) AS minimum, CAST(max({c}) AS VARCHAR) AS maximum'
        " FROM customer"
        for i, (c, t) in enumerate(columns)
    )


@query(
    "C6_profile",
    _profile_sql(
        [
            ("c_custkey", "bigint"),
            ("c_name", "string"),
            ("c_nationkey", "int"),
            ("c_acctbal", "double"),
            ("c_mktsegment", "string"),
        ]
    ),
)
def c6(spark, sf_dir):
    return P.profile(table(spark, sf_dir, "customer"), exact=True)


@query("C6_sample_rows", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def c6_sample(spark, sf_dir):
    return P.sample_rows(table(spark, sf_dir, "customer"), ["c_custkey"])


@query(
    "C7_transform_records",
    """
SELECT row_number() OVER (ORDER BY c_custkey) AS record_no,
  '{"id":' || c_custkey || ',"segment":"' || lower(c_mktsegment) || '","balance":' || CAST(floor(c_acctbal) AS BIGINT)
    || ',"nation":"' || c_nationkey || '"}' AS record
FROM customer
""",
)
def c7(spark, sf_dir):
    spec = P.RecordSpec(
        select=["c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"],
        rename={"c_custkey": "id", "c_mktsegment": "segment", "c_acctbal": "balance", "c_nationkey": "nation"},
        trim=["c_mktsegment"],
        lower=["c_mktsegment"],
        cast={"c_acctbal": "bigint", "c_nationkey": "string"},
    )
    customer = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.floor("c_acctbal").cast("double"))
    return to_json_records(P.transform_records(customer, spec), ["id"])


@query(
    "C8_merge_sources",
    """
SELECT event_id, c_custkey, c_mktsegment, json_extract_string(props, '$.k') AS k
FROM events LEFT JOIN customer ON user_id = c_custkey
""",
)
def c8(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("key"), F.get_json_object("props", "$.k").alias("k")
    )
    side = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_custkey", "c_mktsegment")
    return P.merge_sources(events, side, ["key"]).drop("key")


@query(
    "C9_filter_paths",
    f"SELECT count(*) AS answer FROM ({TREE}) WHERE type = 'blob' AND starts_with(path, 'Brand#1') AND ends_with(path, '.md')",
)
def c9(spark, sf_dir):
    return P.count_paths(derived(spark, sf_dir, TREE), "Brand#1", ".md")
