"""Tables in partitions: run-time pruning, replaced partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.plans.staging import stage_path
from answerloom.sources import layout as L
from catalog import query, table

_BY_MONTH = """
months AS (SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1),
busy AS (SELECT * FROM months WHERE orders * (SELECT count(*) FROM months) > (SELECT sum(orders) FROM months)),
items AS (SELECT *, strftime(CAST(l_shipdate AS DATE), '%Y-%m') AS month FROM lineitem)
"""


def _items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", L.month_of("l_shipdate").alias("month"))
    path = stage_path(spark, "items")
    return L.write_partitioned(items, path, ["month"]), path


def _months(spark, sf_dir):
    """Orders per month, and of all months together, with the number of months."""
    months = table(spark, sf_dir, "orders").groupBy(L.month_of("o_orderdate").alias("month")).agg(F.count("*").alias("orders"))
    every = months.agg(F.count("*").alias("months"), F.sum("orders").alias("all_orders"))
    return months.crossJoin(F.broadcast(every))  # one row


_BUSY = "orders * months > all_orders"


@query(
    "Q16_pruned_join",
    f"""
WITH {_BY_MONTH}
SELECT month, orders, count(*) AS items, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM items JOIN busy USING (month) GROUP BY ALL
""",
)
def q16(spark, sf_dir):
    items, _ = _items(spark, sf_dir)
    met = L.pruned_join(items, _months(spark, sf_dir), ["month"], _BUSY)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return met.groupBy("month", "orders").agg(F.count("*").alias("items"), F.sum(cents).alias("cents"))


@query(
    "Q17_replaced_partitions",
    f"""
WITH {_BY_MONTH}
SELECT month, count(*) AS items,
  CAST(sum(CAST(CASE WHEN month IN (SELECT month FROM busy) THEN 2 * l_quantity ELSE l_quantity END AS BIGINT)) AS BIGINT) AS quantity
FROM items GROUP BY month
""",
)
def q17(spark, sf_dir):
    items, path = _items(spark, sf_dir)
    met = L.pruned_join(items, _months(spark, sf_dir), ["month"], _BUSY)
    doubled = met.select(*items.columns).withColumn("l_quantity", (F.col("l_quantity") * 2).cast(items.schema["l_quantity"].dataType))
    after = L.replace_partitions(doubled, path, ["month"])
    return after.groupBy("month").agg(F.count("*").alias("items"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
