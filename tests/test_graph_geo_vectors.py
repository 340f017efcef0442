import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerloom.operators import geo as X
from answerloom.operators import graph as G
from answerloom.operators import vectors as E
from answerloom.plans import staging


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (4, 6), (7, 8), (2, 1), (9, 9), (None, 3)]
    return G.edges_from(spark.createDataFrame(rows, "a int, b int"))


def sources(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "source int")


def test_edges_and_degrees(edges):
    assert edges.count() == 15
    got = {r.node: (r.degree, r.centrality) for r in G.degrees(edges).collect()}
    assert got[4] == (3, 3 / 8) and got[9][0] == 2 and len(got) == 9


@pytest.mark.parametrize("weight", [None, "w"])
def test_edges_are_told_apart_once_for_both_ways(spark, weight):
    rows = [(1, 2, 3.0), (2, 1, 2.0), (1, 2, 5.0), (3, 3, 1.0), (3, 3, 4.0), (5, 4, None), (None, 1, 1.0), (1, None, 1.0)]
    edges = G.edges_from(spark.createDataFrame(rows, "a int, b long, w double"), weight=weight)
    assert [f.dataType.simpleString() for f in edges.schema][:2] == ["bigint", "bigint"]
    want = {(1, 2): 2.0, (2, 1): 2.0, (3, 3): 1.0, (4, 5): None, (5, 4): None}
    got = edges.collect()
    assert sorted(tuple(r)[:2] for r in got) == sorted(want)
    assert weight is None or {(r.src, r.dst): r.weight for r in got} == want
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # both ways are made of edges told apart: half the rows are held


def test_a_written_table_is_not_written_again(spark):
    made = spark.range(10).selectExpr("id", "id % 3 AS k")
    kept = staging.staged(made)
    assert kept is not made and staging.staged(kept) is kept and staging.staged(kept.where("k = 1")).count() == 3


def test_paths(spark, edges):
    got = {r.node: (r.distance, r.path) for r in G.shortest_paths(edges, sources(spark, 1)).collect()}
    assert got == {
        1: (0.0, [1]), 2: (1.0, [1, 2]), 5: (1.0, [1, 5]), 3: (2.0, [1, 2, 3]), 4: (2.0, [1, 5, 4]), 6: (3.0, [1, 5, 4, 6]),
    }


def test_directed_paths_and_bound(spark):
    edges = G.edges_from(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int"), directed=True)
    got = G.shortest_paths(edges, sources(spark, 2), directed=True)
    assert {r.node: r.path for r in got.collect()} == {2: [2], 3: [2, 3], 1: [2, 3, 1], 4: [2, 3, 4]}
    assert G.shortest_paths(edges, sources(spark, 2), directed=True, max_rounds=1).count() == 2


def test_weighted_paths_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(25), rng.randrange(25), float(rng.randint(1, 9))) for _ in range(60)]
    edges = G.edges_from(spark.createDataFrame(rows, "a int, b int, w double"), weight="w")
    weights = {(r.src, r.dst): r.weight for r in edges.collect()}
    nodes = {a for a, _ in weights}
    dist = {a: {b: 0.0 if a == b else weights.get((a, b), math.inf) for b in nodes} for a in nodes}
    for k in nodes:
        for a in nodes:
            for b in nodes:
                dist[a][b] = min(dist[a][b], dist[a][k] + dist[k][b])
    start = sorted(nodes)[:3]
    got = G.shortest_paths(edges, sources(spark, *start), weight="weight").collect()
    assert {(r.source, r.node): r.distance for r in got} == {
        (s, b): d for s in start for b, d in dist[s].items() if d < math.inf
    }
    for r in got:
        assert sum(weights[p] for p in zip(r.path, r.path[1:])) == r.distance
        assert r.path[0] == r.source and r.path[-1] == r.node


def test_a_hop_shuffles_only_the_newest_nodes(spark, edges):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = G._Stored.of(edges, 2)
        assert {r.src: r.parts for r in stored.hubs.collect()} == {4: 2}
        hop = stored.ahead(sources(spark, 1, 4).select("source", F.col("source").alias("src")))
        assert sorted(tuple(r) for r in hop.select("src", "dst").collect()) == [(1, 2), (1, 5), (4, 3), (4, 5), (4, 6)]
        again = stored.ahead(sources(spark, 1, 4).select("source", F.col("source").alias("src")))
        plan = again._jdf.queryExecution().executedPlan().toString()
        edge_side = plan[plan.rindex("+- Sort") :]
        assert "Bucketed: true" in edge_side and "Exchange" not in edge_side
        assert plan.count("Exchange hashpartitioning") == 3  # the newest nodes and the hubs, then the newest nodes by part
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("answerloom_")]


@pytest.mark.parametrize("hub_edges", [1, 2, 100])
def test_hubs_in_parts_change_nothing(spark, hub_edges):
    rng = random.Random(5)
    rows = [(0, k) for k in range(1, 40)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    weighted = [(a, b, float(rng.randint(0, 5))) for a, b in rows]
    edges = G.edges_from(spark.createDataFrame(weighted, "a int, b int, w double"), weight="w")
    start = sources(spark, 0, 7, 99)
    for weight in (None, "weight"):
        want = sorted(map(tuple, G.shortest_paths(edges, start, weight=weight).collect()))
        assert sorted(map(tuple, G.shortest_paths(edges, start, weight=weight, hub_edges=hub_edges).collect())) == want
    assert (99, 99, 0.0, [99]) in want


def test_closeness(spark, edges):
    got = {r.source: r.closeness for r in G.closeness(edges, sources(spark, 1, 7, 9)).collect()}
    assert got[1] == pytest.approx(5 / 9 * 5 / 8)
    assert got[7] == pytest.approx(1 / 8) and got[9] == 0.0


def test_sources_of_closeness_share_rows(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(rng.randrange(60), 100 + rng.randrange(80)) for _ in range(400)]
    edges = staging.cut_lineage(G.edges_from(spark.createDataFrame(rows, "a int, b int")))
    nodes = len({n for r in rows for n in r})
    written, write = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(write(df)) or written[-1])
    start = edges.select(F.col("src").alias("source")).distinct().where("source < 100")
    assert start.count() > 50 and G.closeness(edges, start).count() == start.count()
    assert max(w.count() for w in written) <= nodes  # not a row per source and node


@pytest.mark.parametrize(("directed", "hub_edges"), [(False, 2), (True, 100)])
def test_closeness_of_many_sources_against_brute_force(spark, directed, hub_edges):
    rng = random.Random(7)
    rows = [(rng.randrange(200), rng.randrange(200)) for _ in range(700)] + [(300 + i, 301 + i) for i in range(4)]
    rows += [(0, 100 + i) for i in range(40)]
    near: dict = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).update(() if directed else (a,))
    starts, want = [*range(150), 302, 999], {None: (0, 0)}
    for s in starts:
        hops, front = {s: 0}, [s]
        while front:
            front = list({n for a in front for n in near.get(a, ())} - hops.keys())
            hops |= dict.fromkeys(front, max(hops.values()) + 1)
        want[s] = (len(hops) - 1, sum(hops.values()))
    edges = G.edges_from(spark.createDataFrame(rows, "a int, b int"), directed=directed)
    got = G.closeness(edges, sources(spark, *starts, 5, None), directed=directed, hub_edges=hub_edges).collect()
    assert len(got) == len(want) and {r.source: (r.reached, r.total_distance) for r in got} == want
    for r in got:
        reached, total = want[r.source]
        assert r.closeness == pytest.approx(reached / total * reached / (len(near) - 1) if total else 0.0)


def test_closeness_of_no_sources(spark, edges):
    assert G.closeness(edges, sources(spark, 1).where("source > 1")).collect() == []


def test_few_new_nodes_are_looked_up_and_no_edge_is_sorted(spark, edges):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = G._Stored.of(edges, 2)
        front = sources(spark, 1, 4).select("source", F.col("source").alias("src"))
        for rows, join in [(2, "ShuffledHashJoin"), (stored.buckets * G._HASHED_ROWS + 1, "SortMergeJoin"), (None, "SortMergeJoin")]:
            hop = stored.ahead(front, rows)
            assert sorted(tuple(r) for r in hop.select("src", "dst").collect()) == [(1, 2), (1, 5), (4, 3), (4, 5), (4, 6)]
            plan = stored.ahead(front, rows)._jdf.queryExecution().executedPlan().toString()
            assert plan.index(join) < plan.index("Bucketed: true")
            edge_side = plan[plan.index("answerloom_") - 200 : plan.index("Bucketed: true")]
            assert "Exchange" not in edge_side and ("Sort" in edge_side) == (join == "SortMergeJoin")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("steps", [1, 3, 10])
def test_chains(spark, steps):
    following = {0: 1, 1: 2, 2: 0, 3: 3, 4: None, 5: 99, 6: 4, 7: 6}
    links = spark.createDataFrame(list(following.items()), "s int, n int")
    for r in G.follow_chain(links, "s", "n", steps).collect():
        chain, at = [r.start], following[r.start]
        while at is not None and len(chain) <= steps:
            chain.append(at)
            at = following.get(at)
        assert r.chain == chain, r.start
        assert r.steps == len(chain) - 1 and r.ended == (len(chain) <= steps)


def km(p, q):
    (a, b), (c, d) = p, q
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(5)
    a = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(80)]
    a += [(100 + i, 89.9 * s, lon) for i, (s, lon) in enumerate([(1, 0.0), (1, 179.0), (-1, 10.0), (0, 180.0), (0, -180.0)])]
    a += [(200 + i, 10.0, 20.0) for i in range(30)]
    b = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    b += [(100, 90.0, 55.0), (101, 0.0, 179.95), (103, 10.0, 20.0), (102, 10.0, 20.0), (104, -89.99, -170.0)]
    b += [(300 + i, 10.0 + i * 0.001, 20.0 - i * 0.002) for i in range(40)]
    schema = "id int, lat double, lon double"
    return a, b, spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


@pytest.mark.parametrize("reach", [5.0, 300.0, 2500.0, 9000.0, 20100.0])
def test_within(places, reach):
    a, b, da, db = places
    want = {(i, j) for i, *p in a for j, *q in b if km(p, q) <= reach}
    assert {(r.id, r.other_id) for r in X.within_distance(da, db, reach).collect()} == want
    counts = {r.id: r.in_range for r in X.count_within(da, db, reach).collect()}
    assert counts == {i: sum((i, j) in want for j, *_ in b) for i, *_ in a}


@pytest.mark.parametrize("start", [None, 50.0, 20100.0])
def test_nearest(places, start):
    a, b, da, db = places
    got = {r.id: (r.nearest_id, round(r.km, 6)) for r in X.nearest(da, db, start).collect()}
    for i, *p in a:
        best = min((km(p, q), j) for j, *q in b)
        assert got[i] == (best[1], round(best[0], 6)), i


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(E.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(math.sqrt(0.5)) and got[1] is None


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + rng.normal(size=8) * 0.3]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(50)] + [(300, [0.0] * 8)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").cache()


@pytest.mark.parametrize("batch", [2, 1024])
def test_most_similar(spark, vectors, monkeypatch, batch):
    monkeypatch.setattr(E, "QUERY_BATCH", batch)
    monkeypatch.setattr(E, "BLOCK_ROWS", 40)
    rows = vectors.collect()
    unit = {r.vec_id: np.array(r.embedding) / (np.linalg.norm(r.embedding) or 1) for r in rows}
    queries = vectors.where("vec_id < 5").selectExpr("vec_id AS query_id", "embedding AS query")
    got: dict = {}
    for r in E.most_similar(vectors, queries, 4).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(5):
        order = sorted((-round(float(unit[q] @ u), 12), i) for i, u in unit.items() if i != 300)
        assert got[q] == [i for _, i in order[:4]]


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.999])
def test_similar_pairs(vectors, threshold, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_ROWS", 16)
    rows = [r for r in vectors.collect() if r.vec_id < 200]
    unit = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows}
    want = {(i, j) for i in unit for j in unit if i < j and round(float(unit[i] @ unit[j]), 12) >= threshold}
    got = E.similar_pairs(vectors, threshold).collect()
    assert len(got) == len({(r.vec_id, r.other_id) for r in got})
    assert {(r.vec_id, r.other_id) for r in got} == want
    assert all((r.copies == 51) == (r.vec_id == 3) and (r.other_copies == 51) == (r.other_id == 3) for r in got)


def test_blocks_grow_with_the_table_so_that_copies_stay_few(vectors):
    copies = lambda rows, least: math.ceil(rows / E._block_rows(rows, least, 64))
    assert copies(600, 32) == 19  # few rows stay in the blocks asked for
    assert all(copies(n, 32) <= 40 for n in (2_000, 100_000, 600_000))
    assert E._block_rows(10**9, 32, 64) * 64 <= 1 << 20  # a task's memory is bounded


def test_blocks_in_strips(vectors, monkeypatch):
    rows = vectors.where("vec_id < 200").collect()
    ids, part = np.array([r.vec_id for r in rows]), pd.Series([r.embedding for r in rows])
    unit = E._unit_rows(part)
    monkeypatch.setattr(E, "_STRIP_SCORES", 500)
    got = E._best(ids[:20], unit[:20], ids, part, 3).groupby("query_id")["vec_id"].apply(list)
    for q in range(20):
        assert got[q] == [i for _, i in sorted((-round(float(unit[q] @ u), 12), i) for i, u in zip(ids, unit))[:3]]
    everything = E._best(ids[:2], unit[:2], ids, part, 500)
    assert len(everything) == 2 * len(ids)


def test_cosines_of_pairs_are_not_rounded(spark):
    a, b = [1.0, 0.0], [0.9, 0.4358898943540674]
    df = spark.createDataFrame([(1, a), (2, b)], "vec_id bigint, embedding array<double>")
    ((got,),) = E.similar_pairs(df, 0.5).select("cosine").collect()
    third = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 1.0, 2.0])], "vec_id bigint, embedding array<double>")
    ((other,),) = E.similar_pairs(third, 0.5).select("cosine").collect()
    assert got == pytest.approx(0.9) and abs(other - 11 / 14) < 1e-15  # 12 digits are 3e-13 off


def test_weights_of_0_end_and_negative_ones_raise(spark):
    edges = spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0), (2, 3, 0.0), (3, 1, 0.0), (1, 3, 0.0)], "src long, dst long, weight double")
    sources = spark.createDataFrame([(1,)], "source long")
    got = {r.node: (r.distance, r.path) for r in G.shortest_paths(edges, sources, weight="weight", directed=True).collect()}
    assert got == {1: (0, [1]), 2: (0, [1, 2]), 3: (0, [1, 3])}
    with pytest.raises(ValueError):
        G.shortest_paths(edges.withColumn("weight", F.lit(-1.0)), sources, weight="weight")
