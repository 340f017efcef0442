"""Chart data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.operators import charts as C
from catalog import query, table


@query("V1_bar_data", "SELECT p_brand, round(sum(p_retailprice), 2) AS value FROM part GROUP BY p_brand")
def v1(spark, sf_dir):
    return C.bar_data(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").select(
        "p_brand", F.round("value", 2).alias("value")
    )


@query(
    "V2_scatter_fit",
    """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 8) AS r2
FROM lineitem GROUP BY l_returnflag
""",
)
def v2(spark, sf_dir):
    fit = C.scatter_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return fit.select(
        "l_returnflag",
        F.round("slope", 6).alias("slope"),
        F.round("intercept", 4).alias("intercept"),
        F.round("r2", 8).alias("r2"),
    )


@query(
    "V3_histogram_data",
    """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 25) AS BIGINT), 24) AS bin, count(*) AS n
  FROM lineitem, e GROUP BY 1)
SELECT b.bin, round(lo + (hi - lo) / 25 * b.bin, 4) AS low, round(lo + (hi - lo) / 25 * (b.bin + 1), 4) AS high,
  coalesce(n, 0) AS n
FROM (SELECT unnest(range(25)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin
""",
)
def v3(spark, sf_dir):
    bins = C.histogram_data(table(spark, sf_dir, "lineitem"), "l_extendedprice", 25)
    return bins.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query(
    "V4_cumulative_line",
    """
SELECT period, round(total, 2) AS total, round(sum(total) OVER (ORDER BY period), 2) AS running_total FROM (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS total FROM orders GROUP BY 1)
""",
)
def v4(spark, sf_dir):
    line = C.cumulative_line(table(spark, sf_dir, "orders"), "o_orderdate", "month", "o_totalprice")
    return line.select("period", F.round("total", 2).alias("total"), F.round("running_total", 2).alias("running_total"))
