"""Graph, geography and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.operators import geo as X
from answerloom.operators import graph as G
from answerloom.operators import vectors as E
from answerloom.plans.staging import staged
from catalog import query, table, wide_table
from catalog.derived import CUSTOMER_POINTS, EDGES, NEXT_LINKS, SUPPLIER_POINTS, derived

_BOTH = f"SELECT src, dst FROM ({EDGES}) UNION SELECT dst, src FROM ({EDGES})"


def _edges(spark, sf_dir):
    items = wide_table(spark, sf_dir, "lineitem")  # as EDGES, but for its DISTINCT: the operator gives each edge once
    return G.edges_from(items.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")))


@query("G1_edges_from", _BOTH)
def g1(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(
    "G2_degrees",
    f"""
SELECT src AS node, count(*) AS degree,
  round(count(*) / (SELECT count(DISTINCT src) - 1.0 FROM ({_BOTH})), 10) AS centrality
FROM ({_BOTH}) GROUP BY src
""",
)
def g2(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir)).withColumn("centrality", F.round("centrality", 10))


# Hubs: the suppliers with the most neighbours in each nation.
_HUBS = f"""
SELECT node FROM (
  SELECT src AS node, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, src) AS r
  FROM ({EDGES}) JOIN supplier ON src = s_suppkey GROUP BY src, s_nationkey) WHERE r = 1
"""
_BFS = f"""
both_ways AS MATERIALIZED ({_BOTH}),
bfs(source, node, d) AS (
  SELECT node, node, 0 FROM ({{0}})
  UNION SELECT source, dst, d + 1 FROM bfs JOIN both_ways ON node = src WHERE d < 6),
dist AS MATERIALIZED (SELECT source, node, min(d) AS d FROM bfs GROUP BY source, node)
"""


def _hubs(spark, sf_dir, edges):
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), "s_nationkey")
    least, most = nation.agg(F.min("src"), F.max("src")).first()
    degree = edges.where(F.col("src").between(least, most)).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    best = degree.join(nation, "src").groupBy("s_nationkey").agg(
        F.min_by("src", F.struct(-F.col("n"), "src")).alias("source")
    )
    return best.select("source")


@query(
    "G3_shortest_paths",
    f"""
WITH RECURSIVE {_BFS.format("SELECT min(src) AS node FROM (" + EDGES + ")")},
pred AS MATERIALIZED (SELECT b.source, b.node, b.d, min(a.node) AS p FROM dist b JOIN both_ways ON dst = b.node
  JOIN dist a ON a.source = b.source AND a.node = src AND a.d + 1 = b.d GROUP BY ALL),
walk(source, node, d, path) AS (
  SELECT DISTINCT source, source, 0, CAST(source AS VARCHAR) FROM dist
  UNION ALL SELECT pred.source, pred.node, pred.d, path || '>' || pred.node
  FROM walk JOIN pred ON pred.source = walk.source AND pred.p = walk.node AND pred.d = walk.d + 1)
SELECT node, CAST(d AS DOUBLE) AS distance, path FROM walk
""",
)
def g3(spark, sf_dir):
    edges = staged(_edges(spark, sf_dir))
    source = edges.agg(F.min("src").alias("source"))
    found = G.shortest_paths(edges, source)
    return found.select("node", "distance", G.path_text(F.col("path")).alias("path"))


# Routes between nations, from suppliers to customers; lengths follow from the quantities shipped.
_TRADE = """
SELECT s_nationkey AS a, c_nationkey AS b, CAST(1 + CAST(sum(l_quantity) AS BIGINT) % 1000 AS DOUBLE) AS w
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey
GROUP BY ALL
"""
_TRADE_BOTH = f"SELECT src, dst, min(w) AS w FROM (SELECT a AS src, b AS dst, w FROM ({_TRADE}) UNION ALL SELECT b, a, w FROM ({_TRADE})) GROUP BY ALL"


_WALKS = """
walk(source, node, d, hops) AS (
  SELECT DISTINCT src, src, CAST(0 AS DOUBLE), 0 FROM e
  UNION SELECT source, dst, least_d, h FROM (
    SELECT source, dst, min(d + w) AS least_d, max(hops) + 1 AS h FROM walk JOIN e ON node = src
    WHERE hops < 24 GROUP BY source, dst)),
best AS MATERIALIZED (SELECT source, node, min(d) AS d, min_by(hops, struct_pack(d := d, h := hops)) AS hops FROM walk GROUP BY source, node),
pred AS MATERIALIZED (SELECT b.source, b.node, min(a.node) AS p FROM best b JOIN e ON dst = b.node
  JOIN best a ON a.source = b.source AND a.node = src AND a.d + w = b.d AND a.hops + 1 = b.hops WHERE b.node <> b.source GROUP BY ALL),
way(source, node, path) AS (
  SELECT source, source, CAST(source AS VARCHAR) FROM best WHERE node = source
  UNION ALL SELECT pred.source, pred.node, path || '>' || pred.node FROM way JOIN pred ON pred.source = way.source AND pred.p = way.node)
SELECT source, node, round(d, 6) AS distance, path FROM way JOIN best USING (source, node)
"""


def _trade(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return (
        items.join(orders, "l_orderkey")
        .join(customers, "o_custkey")
        .join(suppliers, "l_suppkey")
        .where("s_nationkey <> c_nationkey")
        .groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))
        .agg((1 + F.sum("l_quantity").cast("bigint") % 1000).cast("double").alias("w"))
    )


def _weighted(edges):
    found = G.shortest_paths(edges, edges.select(F.col("src").alias("source")), weight="weight")
    return found.select("source", "node", F.round("distance", 6).alias("distance"), G.path_text(F.col("path")).alias("path"))


@query("G3_weighted_paths", f"WITH RECURSIVE e AS MATERIALIZED ({_TRADE_BOTH}), {_WALKS}")
def g3_weighted(spark, sf_dir):
    return _weighted(G.edges_from(_trade(spark, sf_dir), weight="w"))


_WEIGHTLESS = f"SELECT src, dst, CASE WHEN w < 300 THEN 0 ELSE w END AS w FROM ({_TRADE_BOTH})"


@query("G3_paths_with_weight_0", f"WITH RECURSIVE e AS MATERIALIZED ({_WEIGHTLESS}), {_WALKS}")
def g3_weight_0(spark, sf_dir):
    edges = G.edges_from(_trade(spark, sf_dir), weight="w")
    return _weighted(edges.withColumn("weight", F.when(F.col("weight") < 300, 0.0).otherwise(F.col("weight"))))


@query(
    "G4_closeness",
    f"""
WITH RECURSIVE {_BFS.format(_HUBS)}
SELECT source, count(*) - 1 AS reached, CAST(sum(d) AS BIGINT) AS total_distance,
  round((count(*) - 1) * (count(*) - 1) / sum(d) / (SELECT count(DISTINCT src) - 1.0 FROM both_ways), 10) AS closeness
FROM dist GROUP BY source
""",
)
def g4(spark, sf_dir):
    edges = staged(_edges(spark, sf_dir))
    found = G.closeness(edges, _hubs(spark, sf_dir, edges))
    return found.withColumn("closeness", F.round("closeness", 10))


@query(
    "G5_follow_chain",
    f"""
WITH RECURSIVE links AS MATERIALIZED ({NEXT_LINKS}),
walk(start, node, steps, path) AS (
  SELECT start, start, 0, CAST(start AS VARCHAR) FROM links
  UNION ALL SELECT walk.start, links.next, steps + 1, path || '>' || links.next
  FROM walk JOIN links ON node = links.start WHERE steps < 10 AND links.next IS NOT NULL)
SELECT start, CAST(max(steps) AS INT) AS steps, max_by(path, steps) AS chain FROM walk GROUP BY start
""",
)
def g5(spark, sf_dir):
    chains = G.follow_chain(derived(spark, sf_dir, NEXT_LINKS), "start", "next")
    return chains.select("start", "steps", G.path_text(F.col("chain")).alias("chain"))


def _sql_distance(a: str, b: str) -> str:
    return (
        f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat))"
        f" * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


@query(
    "X1_haversine",
    f"""
SELECT a.id, round({_sql_distance("a", "b")}, 6) AS km
FROM ({CUSTOMER_POINTS}) a JOIN ({SUPPLIER_POINTS}) b ON b.id = a.id % (SELECT count(*) FROM supplier)
""",
)
def x1(spark, sf_dir):
    a = derived(spark, sf_dir, CUSTOMER_POINTS)
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    b = derived(spark, sf_dir, SUPPLIER_POINTS).select(
        F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")
    )
    pairs = a.withColumn("other", F.col("id") % suppliers).join(b, "other")
    km = X.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return pairs.select("id", F.round(km, 6).alias("km"))


_KM = f"SELECT a.id, b.id AS other_id, {_sql_distance('a', 'b')} AS km FROM ({CUSTOMER_POINTS}) a, ({SUPPLIER_POINTS}) b"


@query("X2_within_distance", f"SELECT id, other_id, round(km, 6) AS km FROM ({_KM}) WHERE km <= 800")
def x2(spark, sf_dir):
    a, b = derived(spark, sf_dir, CUSTOMER_POINTS), derived(spark, sf_dir, SUPPLIER_POINTS)
    return X.within_distance(a, b, 800.0).withColumn("km", F.round("km", 6))


@query("X2_count_within", f"SELECT id, count(*) FILTER (WHERE km <= 1500) AS in_range FROM ({_KM}) GROUP BY id")
def x2_count(spark, sf_dir):
    a, b = derived(spark, sf_dir, CUSTOMER_POINTS), derived(spark, sf_dir, SUPPLIER_POINTS)
    return X.count_within(a, b, 1500.0)


@query(
    "X2_nearest",
    f"SELECT id, arg_min(other_id, {{'k': km, 'i': other_id}}) AS nearest_id, round(min(km), 6) AS km FROM ({_KM}) GROUP BY id",
)
def x2_nearest(spark, sf_dir):
    a, b = derived(spark, sf_dir, CUSTOMER_POINTS), derived(spark, sf_dir, SUPPLIER_POINTS)
    return X.nearest(a, b, 500.0).withColumn("km", F.round("km", 6))


_DOUBLES = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


@query(
    "E1_cosine",
    f"""
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 8) AS cosine
FROM ({_DOUBLES}) a JOIN ({_DOUBLES}) b ON a.vec_id = b.vec_id + 1
""",
)
def e1(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = vectors.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(before, "vec_id").select(
        "vec_id", F.round(E.cosine(F.col("embedding"), F.col("other")), 8).alias("cosine")
    )


@query(
    "E2_most_similar",
    f"""
SELECT query_id, vec_id, round(c, 8) AS cosine, CAST(place AS INT) AS place FROM (
  SELECT q.label AS query_id, a.vec_id, list_cosine_similarity(q.v, a.v) AS c, row_number() OVER (
    PARTITION BY q.label ORDER BY round(list_cosine_similarity(q.v, a.v), 12) DESC, a.vec_id) AS place
  FROM (SELECT label, min_by(v, vec_id) AS v FROM ({_DOUBLES}) GROUP BY label) q, ({_DOUBLES}) a)
WHERE place <= 10
""",
)
def e2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))
    found = E.most_similar(vectors, queries, 10)
    return found.withColumn("cosine", F.round("cosine", 8))


_TENTH_SQL = f"""
SELECT query_id, vec_id, round(c, 8) AS cosine, CAST(place AS INT) AS place FROM (
  SELECT q.vec_id AS query_id, a.vec_id, list_cosine_similarity(q.v, a.v) AS c, row_number() OVER (
    PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, a.v), 12) DESC, a.vec_id) AS place
  FROM ({_DOUBLES}) q, ({_DOUBLES}) a WHERE q.vec_id % 10 = 0)
WHERE place <= 3
"""


@query("E2_most_similar_in_blocks", _TENTH_SQL)
def e2_blocks(spark, sf_dir):
    """More queries than go with the tasks: blocks of queries meet blocks of vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = E.most_similar(vectors, queries, 3, query_batch=16, block_rows=128)
    return found.withColumn("cosine", F.round("cosine", 8))


@query(
    "E2_similar_pairs_in_regions",
    f"""
WITH d AS (SELECT v, min(vec_id) AS vec_id, count(*) AS copies FROM ({_DOUBLES}) GROUP BY v)
SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.v, b.v), 8) AS cosine, a.copies,
  b.copies AS other_copies
FROM d a JOIN d b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.45
""",
)
def e2_regions(spark, sf_dir):
    """Several regions, and several blocks in each."""
    pairs = E.similar_pairs(table(spark, sf_dir, "embeddings"), 0.45, block_rows=32)
    return pairs.withColumn("cosine", F.round("cosine", 8))


@query(
    "E2_similar_pairs",
    f"""
WITH d AS (SELECT v, min(vec_id) AS vec_id, count(*) AS copies FROM ({_DOUBLES}) GROUP BY v)
SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.v, b.v), 8) AS cosine, a.copies,
  b.copies AS other_copies
FROM d a JOIN d b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.45
""",
)
def e2_pairs(spark, sf_dir):
    return E.similar_pairs(table(spark, sf_dir, "embeddings"), 0.45).withColumn("cosine", F.round("cosine", 8))
