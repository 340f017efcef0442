"""The SQL entry and one query per relational category."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.operators import maintained
from answerloom.operators import relational as R
from answerloom.operators.table_functions import sql_with_functions, step_runs
from answerloom.plans.ranges import neighbour, ranked, running
from catalog import query, table


def _both(name: str, sql: str, *tables: str) -> None:
    """The same SQL on both sides, through the SQL entry."""

    def run(spark, sf_dir):
        return R.sql_query(spark, {t: table(spark, sf_dir, t) for t in tables}, sql)

    query(name, sql)(run)


_both(
    "Q1_sql_query",
    """
SELECT n_name, count(*) AS customers, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""",
    "customer",
    "nation",
)


@query(
    "Q2_project_filter",
    """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
  CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'medium' ELSE 'small' END AS size_class
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%' AND l_discount BETWEEN 0.02 AND 0.04
""",
)
def q2(spark, sf_dir):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    quantity = F.col("l_quantity")
    size_class = F.when(quantity >= 40, "large").when(quantity >= 20, "medium").otherwise("small")
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag").isin("A", "R") & F.col("l_linestatus").like("F%"))
        .where(F.col("l_discount").between(0.02, 0.04))
        .select("l_orderkey", "l_linenumber", F.round(charge, 6).alias("charge"), size_class.alias("size_class"))
    )


@query(
    "Q3_inner_join",
    """
SELECT o_orderpriority, count(*) AS items, round(sum(l_extendedprice), 2) AS price
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderpriority
""",
)
def q3_inner(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return (
        orders.join(items, "o_orderkey")
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    )


def _orders_per_customer(spark, sf_dir):
    # Added up before the join, so a customer with very many orders is one row.
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "Q3_left_join",
    """
SELECT c_custkey, count(o_orderkey) AS n
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY c_custkey
""",
)
def q3_left(spark, sf_dir):
    counted = table(spark, sf_dir, "customer").join(_orders_per_customer(spark, sf_dir), "c_custkey", "left")
    return counted.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "Q3_right_join",
    """
SELECT n_nationkey, count(s_suppkey) AS suppliers
FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey
""",
)
def q3_right(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    counted = rich.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    return counted.join(nations, "n_nationkey", "right").select(
        "n_nationkey", F.coalesce("n", F.lit(0)).alias("suppliers")
    )


@query(
    "Q3_full_join",
    """
SELECT coalesce(c.k, s.k) AS bucket, c.n AS customers, s.n AS suppliers
FROM (SELECT CAST(floor(c_acctbal / 10) AS BIGINT) AS k, count(*) AS n FROM customer GROUP BY 1) c
FULL JOIN (SELECT CAST(floor(s_acctbal / 10) AS BIGINT) AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k
""",
)
def q3_full(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_acctbal") / 10).alias("bucket"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_acctbal") / 10).alias("bucket"))
    left = customers.agg(F.count(F.lit(1)).alias("customers"))
    return left.join(suppliers.agg(F.count(F.lit(1)).alias("suppliers")), "bucket", "full")


@query(
    "Q3_semi_join",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)",
)
def q3_semi(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(sold, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query(
    "Q3_anti_join",
    """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
""",
)
def q3_anti(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(pending, "c_custkey", "left_anti").select("c_custkey", "c_name")


_BANDS = "SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) + 1 AS high FROM part GROUP BY p_brand"


@query(
    "Q3_theta_join",
    f"""
SELECT p_brand, count(*) AS items
FROM lineitem JOIN ({_BANDS}) ON l_extendedprice >= low AND l_extendedprice < high GROUP BY p_brand
""",
)
def q3_theta(spark, sf_dir):
    bands = (
        table(spark, sf_dir, "part")
        .groupBy("p_brand")
        .agg(F.min("p_retailprice").alias("low"), (F.max("p_retailprice") + 1).alias("high"))
    )
    # Equal prices are counted before they meet the bands.
    prices = table(spark, sf_dir, "lineitem").groupBy("l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    joined = R.band_join(prices, "l_extendedprice", bands, "low", "high", 500.0)
    return joined.groupBy("p_brand").agg(F.sum("n").alias("items"))


@query(
    "Q4_group_having",
    """
SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) AS items, max(l_quantity) AS most
FROM lineitem GROUP BY l_suppkey HAVING count(*) > 590 AND count(DISTINCT l_partkey) > 10
""",
)
def q4(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.count_distinct("l_partkey").alias("parts"),
            F.count(F.lit(1)).alias("items"),
            F.max("l_quantity").alias("most"),
        )
        .where("items > 590 AND parts > 10")
    )


_SUBTOTAL = "count(*) AS n, sum(l_quantity) AS quantity"
for _name, _groups in {
    "Q5_rollup": "ROLLUP (l_returnflag, l_linestatus)",
    "Q5_cube": "CUBE (l_returnflag, l_linestatus)",
    "Q5_grouping_sets": "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())",
}.items():
    _both(
        _name,
        f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g1, "
        f"CAST(grouping(l_linestatus) AS INT) AS g2, {_SUBTOTAL} FROM lineitem GROUP BY {_groups}",
        "lineitem",
    )


@query(
    "Q6_ranking",
    """
SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS row_number,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rank,
  dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS dense_rank,
  ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS ntile
FROM orders
""",
)
def q6(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranked(orders, ["o_orderpriority"], "o_totalprice", ["o_orderkey"]).drop("o_totalprice")


@query(
    "Q6_lag_lead",
    """
SELECT o_orderkey, lag(o_totalprice) OVER w AS previous_price, lead(o_totalprice) OVER w AS next_price
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""",
)
def q6_lag(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    order = ["o_orderdate", "o_orderkey"]
    before = neighbour(orders, ["o_custkey"], order, {"previous_price": "o_totalprice"})
    both = neighbour(before, ["o_custkey"], order, {"next_price": "o_totalprice"}, ahead=True)
    return both.select("o_orderkey", "previous_price", "next_price")


@query(
    "Q7_running_sum",
    """
SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 4) AS running_value,
  count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS so_far
FROM events
""",
)
def q7(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    measures = {"running_value": ("sum", F.col("value")), "so_far": ("count", F.lit(1))}
    out = running(events, ["event_type"], ["ts", "event_id"], measures)
    return out.select("event_id", F.round("running_value", 4).alias("running_value"), "so_far")


@query(
    "Q7_moving_average",
    """
SELECT event_type, CAST(period AS DATE) AS period, round(total, 4) AS total,
  round(sum(total) OVER (PARTITION BY event_type ORDER BY period), 4) AS running_total,
  round(avg(total) OVER (PARTITION BY event_type ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4)
    AS moving_average
FROM (SELECT event_type, date_trunc('day', ts) AS period, sum(value) AS total FROM events GROUP BY 1, 2)
""",
)
def q7_moving(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = R.moving_average(events, ["event_type"], F.col("ts").cast("date"), "value", 7)
    return out.select(
        "event_type",
        "period",
        *[F.round(c, 4).alias(c) for c in ("total", "running_total", "moving_average")],
    )


@query(
    "Q8_set_operations",
    """
SELECT 'union_all' AS op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM
  (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'union', count(*), CAST(sum(k) AS BIGINT) FROM
  (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'intersect', count(*), CAST(sum(k) AS BIGINT) FROM
  (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'except', count(*), CAST(sum(k) AS BIGINT) FROM
  (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'except_all', count(*), CAST(sum(k) AS BIGINT) FROM
  (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""",
)
def q8(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    results = {
        "union_all": a.unionByName(b),
        "union": a.unionByName(b).distinct(),
        "intersect": a.intersect(b),
        "except": a.subtract(b),
        "except_all": a.exceptAll(b),
    }
    parts = [
        df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))
        for op, df in results.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("Q9_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q9(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(
    "Q9_top_k_per_group",
    """
SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, CAST(place AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem)
WHERE place <= 5
""",
)
def q9_groups(spark, sf_dir):
    order = [F.desc("l_extendedprice"), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    top = R.top_k(table(spark, sf_dir, "lineitem"), ["l_returnflag"], order, 5)
    return top.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "place")


_both(
    "Q10_subqueries",
    """
SELECT s_suppkey, s_name, (SELECT count(*) FROM nation) AS nations
FROM supplier s
WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)
  AND s_acctbal >= (SELECT avg(x.s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey)
""",
    "supplier",
    "nation",
    "lineitem",
)


@query(
    "Q11_scalars",
    r"""
SELECT o_orderkey, upper(trim(o_orderpriority)) AS priority, regexp_replace(o_orderpriority, '^(\d)-', '\1 ') AS spaced,
  substring(o_orderpriority, 3, 4) AS part, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, year(o_orderdate) AS year,
  round(ln(o_totalprice), 6) AS log_price, round(sqrt(o_totalprice), 6) AS root, o_custkey % 7 AS modulo,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands
FROM orders
""",
)
def q11(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.upper(F.trim("o_orderpriority")).alias("priority"),
        F.regexp_replace("o_orderpriority", r"^(\d)-", "$1 ").alias("spaced"),
        F.substring("o_orderpriority", 3, 4).alias("part"),
        F.date_trunc("month", "o_orderdate").cast("date").alias("month"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("bigint").alias("days"),
        F.year("o_orderdate").cast("bigint").alias("year"),
        F.round(F.log("o_totalprice"), 6).alias("log_price"),
        F.round(F.sqrt("o_totalprice"), 6).alias("root"),
        (F.col("o_custkey") % 7).alias("modulo"),
        F.floor(F.col("o_totalprice") / 1000).alias("thousands"),
    )


@query(
    "Q12_json_arrays_maps",
    """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CAST(list_sum(list_transform(range(1, 4), lambda x: x * CAST(json_extract_string(props, '$.k') AS BIGINT))) AS BIGINT)
    AS tripled,
  MAP {'click': 1, 'view': 2, 'purchase': 3}[event_type] AS code, array_to_string(json_keys(props), ',') AS names
FROM events
""",
)
def q12(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    codes = F.create_map(*[F.lit(x) for x in ("click", 1, "view", 2, "purchase", 3)])
    tripled = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.lit(3)), lambda x: x * k), F.lit(0).cast("bigint"), lambda s, x: s + x
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        k.alias("k"),
        tripled.alias("tripled"),
        F.try_element_at(codes, F.col("event_type")).alias("code"),
        F.array_join(F.json_object_keys("props"), ",").alias("names"),
    )


@query(
    "Q12_explode",
    "SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k",
)
def q12_explode(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("k"))
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "Q1_table_function",
    """
WITH marked AS (
  SELECT user_id AS session, ts, event_id, event_type, date_trunc('day', ts) AS day,
    CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id)),
numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY session, day ORDER BY ts, event_id) AS BIGINT) AS run FROM marked)
SELECT session, run, event_type AS step, min(ts) AS first_at, max(ts) AS last_at, count(*) AS steps FROM numbered GROUP BY session, day, run, event_type
""",
)
def q1_table_function(spark, sf_dir):
    # Some hundreds of instances, each with the days of many sessions one after another.
    sql = """
SELECT * FROM step_runs(TABLE(SELECT *, pmod(xxhash64(session, day), 1024) AS part FROM (
    SELECT user_id AS session, ts AS at, event_type AS step, date_trunc('day', ts) AS day, event_id FROM events))
  PARTITION BY part ORDER BY (session, day, at, event_id))
"""
    return sql_with_functions(spark, {"events": table(spark, sf_dir, "events")}, {"step_runs": step_runs("session", "day")}, sql)


@query(
    "Q15_maintained_aggregates",
    """
SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS least, max(cents) AS most, sum(cents) / count(cents) AS mean
FROM (SELECT user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS cents FROM events) WHERE event_type <> 'error' GROUP BY user_id
""",
)
def q15(spark, sf_dir):
    # Signups and clicks are there first; the other events come as one batch, and then all errors are taken back.
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("cents"))
    first = F.col("event_type").isin("signup", "click")
    now = maintained.aggregated(events.where(first), ["user_id"], "cents")
    come = events.where(~first).withColumn("sign", F.lit(1))
    now = maintained.apply_changes(now, come, events, ["user_id"], "cents")
    errors = events.where("event_type = 'error'").withColumn("sign", F.lit(-1))
    now = maintained.apply_changes(now, errors, events.where("event_type <> 'error'"), ["user_id"], "cents")
    return maintained.with_mean(now).drop("known")
