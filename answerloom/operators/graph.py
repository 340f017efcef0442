"""Graphs as edge tables: degrees, shortest paths, closeness, pointer chains.

Searches go level by level: one join of the newest nodes with the edges, with
the candidates reduced to one per node before they are shuffled. The edges are
written once, in buckets by their first node, so that no level shuffles
them again; each level is written to the shared folder, so plans stay short and a lost
executor does not undo earlier levels. Where only distances are wanted, 64 sources go
together: a row is a node with a bit per source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.plans.ranges import RANGE_BYTES, plan_bytes, running
from answerloom.plans.staging import cut_in_buckets, cut_lineage, staged

#: A node of more edges has them in several parts of about as many, so that it is never one task's work.
#: A front row is then copied once to this many rows that come of it.
HUB_EDGES = 10_000
_MOST_BUCKETS = 100_000  # Spark's own limit
_HASHED_ROWS = 500_000  # front rows of a bucket that a task may hold in a hash table
_WORD = 64  # sources that share a row of ``_waves``


def edges_from(df: DataFrame, directed: bool = False, weight: str | None = None) -> DataFrame:
    """The first two columns as ``src``, ``dst``; both ways unless directed; each edge once.

    Of parallel edges the least ``weight`` is kept.
    """
    first, second = df.columns[:2]
    kept = df.select(F.col(first).alias("src"), F.col(second).alias("dst"), *([F.col(weight).alias("weight")] if weight else []))
    kept = kept.where("src IS NOT NULL AND dst IS NOT NULL")
    if not directed:  # both ways are one edge until they are told apart, so half the rows are shuffled and held
        kept = kept.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    kept = kept.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if weight else kept.distinct()
    if directed:
        return kept
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))
    return kept.select(F.explode(ways).alias("e"), *(["weight"] if weight else [])).select("e.*", *(["weight"] if weight else []))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree and degree centrality per node of an undirected edge table. A loop counts twice.

    The edges are written first, so no task holds edges to tell apart and nodes to count at once.
    """
    counted = staged(edges).groupBy(F.col("src").alias("node")).agg(
        (F.count(F.lit(1)) + F.count_if(F.col("src") == F.col("dst"))).alias("degree")
    )
    others = counted.agg(F.count(F.lit(1)) - 1).scalar()
    return counted.select("node", "degree", F.try_divide(F.col("degree"), others).alias("centrality"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class _Stored:
    """Edges in buckets by (src, part), and ``hubs``: nodes with more than one part and how many.

    There is at most one hub to ``HUB_EDGES`` edges. ``firsts`` is the number of nodes with an edge from them.
    """

    edges: DataFrame
    hubs: DataFrame
    buckets: int
    firsts: int

    @classmethod
    def of(cls, edges: DataFrame, hub_edges: int) -> _Stored:
        edges = staged(edges)  # read twice
        out = cut_lineage(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
        hubs = out.where(F.col("n") > hub_edges).select("src", F.ceil(F.col("n") / hub_edges).cast("int").alias("parts"))
        hubs = cut_lineage(hubs)
        part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int")
        dealt = edges.join(hubs, "src", "left").select(*edges.columns, part.alias("part"))
        least = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the front may be larger than the edges
        buckets = min(_MOST_BUCKETS, max(least, math.ceil(plan_bytes(edges) / RANGE_BYTES)))
        return cls(cut_in_buckets(dealt, ["src", "part"], buckets), hubs, buckets, out.count())

    def ahead(self, front: DataFrame, rows: int | None = None) -> DataFrame:
        """Rows of ``front``, whose nodes are called ``src``, with every edge from there. Only ``front`` is shuffled.

        If it is said to have few ``rows`` to a bucket, they are looked up in a hash table and the edges are not sorted either.
        """
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        front = front.join(self.hubs, "src", "left").select(*front.columns, parts)
        if rows is not None and rows <= self.buckets * _HASHED_ROWS:
            front = front.hint("shuffle_hash")
        return front.join(self.edges, ["src", "part"]).drop("part")


def _node_count(stored: _Stored, directed: bool) -> int:
    """Nodes of the stored edges; without direction every node is a ``src``."""
    if directed:
        return stored.edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    return stored.firsts


def _levels(stored: _Stored, sources: DataFrame, directed: bool = False, max_rounds: int | None = None) -> DataFrame:
    """Breadth-first levels, with one path per node, ties by the smallest predecessor.

    The search ends without another hop, which would be the widest and find nothing, once every source has reached every node.
    """
    level = cut_lineage(
        sources.select(
            "source",
            F.col("source").alias("node"),
            F.lit(0).cast("bigint").alias("hops"),
            F.array("source").alias("path"),
        )
    )
    levels = [level]
    reached = new = level.count()
    most = reached * _node_count(stored, directed)
    rounds = 0
    while reached != most and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        ahead = stored.ahead(level.select("source", F.col("node").alias("src")), new)
        met = ahead.groupBy("source", F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
        # Without direction a neighbour is at most one level back.
        seen = levels if directed else levels[-2:]
        met = met.join(_union([s.select("source", "node") for s in seen]), ["source", "node"], "left_anti")
        so_far = level.select("source", F.col("node").alias("pred"), "path")
        met = met.join(so_far, ["source", "pred"]).withColumn("path", F.concat("path", F.array("node")))
        level = cut_lineage(met.select("source", "node", F.lit(rounds).cast("bigint").alias("hops"), "path"))
        new = level.count()
        if not new:
            break
        reached += new
        levels.append(level)
    return _union(levels)


def _waves(stored: _Stored, sources: DataFrame, nodes: int, directed: bool = False) -> DataFrame:
    """``(node, word, bits, hops)``: breadth-first levels, where the sources with a number in ``word`` share a row of a node.

    ``sources`` has ``(source, word, bit)``. A hop makes a row per edge of a new node and word, however many sources met there,
    and one row per node and word is left of them before the shuffle. The bits met in earlier levels are taken off in the same
    grouping. The search ends as in ``_levels``.
    """
    level = cut_lineage(sources.select(F.col("source").alias("node"), "word", F.expr("shiftleft(1L, bit)").alias("bits")))
    levels = [level]
    reached = rows = level.count()
    most = reached * nodes
    none = F.lit(0).cast("bigint")
    while reached != most:
        ahead = stored.ahead(level.withColumnRenamed("node", "src"), rows)
        met = ahead.select(F.col("dst").alias("node"), "word", "bits", none.alias("seen"))
        # Without direction a neighbour is at most one level back.
        seen = _union(levels if directed else levels[-2:]).select("node", "word", none.alias("bits"), F.col("bits").alias("seen"))
        both = met.unionByName(seen).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"))
        new = both.select("node", "word", F.col("bits").bitwiseAND(F.bitwise_not("seen")).alias("bits")).where("bits != 0")
        level = cut_lineage(new)
        rows, found = level.agg(F.count(F.lit(1)), F.sum(F.bit_count("bits"))).first()
        if not rows:
            break
        reached += found
        levels.append(level)
    return _union([w.withColumn("hops", F.lit(hops).cast("bigint")) for hops, w in enumerate(levels)])


def _distances(stored: _Stored, sources: DataFrame, max_rounds: int | None) -> DataFrame:
    """Least ``way`` (distance, hops) per source and node: only nodes that improved are followed further.

    Hops break ties, so that steps of weight 0 lead away from the source and every path ends. A round
    writes the improved nodes only; what earlier rounds wrote is put together again when it has doubled.
    """
    start = F.struct(F.lit(0.0).alias("distance"), F.lit(0).cast("bigint").alias("hops")).alias("way")
    changed = cut_lineage(sources.select("source", F.col("source").alias("node"), start))
    base, recent = changed, []
    base_rows = rows = changed.count()
    recent_rows = 0
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        step = F.struct((F.col("way.distance") + F.col("weight")).alias("distance"), (F.col("way.hops") + 1).alias("hops"))
        ahead = stored.ahead(changed.withColumnRenamed("node", "src"), rows)
        offers = ahead.groupBy("source", F.col("dst").alias("node")).agg(F.min(step).alias("offer"))
        held = _union([base, *recent]).groupBy("source", "node").agg(F.min("way").alias("way"))
        better = offers.join(held, ["source", "node"], "left").where("way IS NULL OR offer < way")
        changed = cut_lineage(better.select("source", "node", F.col("offer").alias("way")))
        rows = changed.count()
        if not rows:
            break
        recent.append(changed)
        recent_rows += rows
        if recent_rows > base_rows:
            base = cut_lineage(_union([base, *recent]).groupBy("source", "node").agg(F.min("way").alias("way")))
            recent, base_rows, recent_rows = [], base_rows + recent_rows, 0
    return _union([base, *recent]).groupBy("source", "node").agg(F.min("way").alias("way"))


def _climb(tree: DataFrame, sources: DataFrame) -> DataFrame:
    """Paths in a search tree per source, given as ``(source, node, pred)``.

    Each round joins the way up from a node with the way up from where it
    ends, so ways double in length and the rounds are few.
    """
    ways = cut_lineage(tree.select("source", "node", F.array("pred").alias("way"), F.col("pred").alias("top")))
    while not (moving := ways.where("top != source")).isEmpty():
        on = ways.select("source", F.col("node").alias("top"), F.col("way").alias("on"), F.col("top").alias("next"))
        longer = moving.join(on, ["source", "top"]).select(
            "source", "node", F.concat("way", "on").alias("way"), F.col("next").alias("top")
        )
        ways = cut_lineage(longer.unionByName(ways.where("top = source")))
    paths = ways.select("source", "node", F.concat(F.reverse("way"), F.array("node")).alias("path"))
    return paths.unionByName(
        sources.select("source", F.col("source").alias("node"), F.array("source").alias("path"))
    )


def shortest_paths(
    edges: DataFrame,
    sources: DataFrame,
    weight: str | None = None,
    directed: bool = False,
    max_rounds: int | None = None,
    hub_edges: int = HUB_EDGES,
) -> DataFrame:
    """``(source, node, distance, path)`` for every node each source reaches.

    ``sources`` has a column ``source``. Distances are hops, or sums of a ``weight`` that is
    not negative (else ValueError). Among equal paths one of fewest hops is taken, then the smallest predecessor.
    A node of over ``hub_edges`` edges is searched in parts; that changes no result.
    """
    sources = sources.select("source").distinct()
    if weight is None:
        found = _levels(_Stored.of(edges, hub_edges), sources, directed=directed, max_rounds=max_rounds)
        return found.select("source", "node", F.col("hops").cast("double").alias("distance"), "path")
    stored = _Stored.of(edges.select("src", "dst", F.col(weight).cast("double").alias("weight")), hub_edges)
    if not stored.edges.where("weight < 0 OR isnan(weight)").isEmpty():
        raise ValueError("weights must not be negative")
    best = _distances(stored, sources, max_rounds)
    start = best.select("source", F.col("node").alias("src"), F.col("way").alias("w0"))
    end = best.select("source", F.col("node").alias("dst"), F.col("way").alias("w1"))
    tree = (
        stored.ahead(start)
        .join(end, ["source", "dst"])
        .where("w0.distance + weight = w1.distance AND w0.hops + 1 = w1.hops AND dst != source")
        .groupBy("source", F.col("dst").alias("node"))
        .agg(F.min("src").alias("pred"))
    )
    paths = _climb(tree, sources)
    return paths.join(best, ["source", "node"]).select("source", "node", F.col("way.distance").alias("distance"), "path")


def closeness(edges: DataFrame, sources: DataFrame, directed: bool = False, hub_edges: int = HUB_EDGES) -> DataFrame:
    """Closeness of the sources: nodes reached over total distance, scaled by the share of nodes reached."""
    stored = _Stored.of(edges, hub_edges)
    nodes = _node_count(stored, directed)
    sources = cut_lineage(sources.select("source").distinct())
    place = F.col("place") - 1
    numbered = running(sources, [], ["source"], {"place": ("count", F.lit(1))}).select(
        "source", F.floor(place / _WORD).alias("word"), (place % _WORD).cast("int").alias("bit")
    )
    numbered = cut_lineage(numbered)
    # The rows of a word are counted for all its bits at once.
    bits = [F.sum(F.shiftright("bits", i).bitwiseAND(F.lit(1))) for i in range(max(1, min(_WORD, numbered.count())))]
    counts = _waves(stored, numbered, nodes, directed).groupBy("word", "hops").agg(*[b.alias(f"b{i}") for i, b in enumerate(bits)])
    counts = counts.select("word", "hops", F.posexplode(F.array(*[f"b{i}" for i in range(len(bits))])).alias("bit", "n"))
    sums = counts.join(numbered, ["word", "bit"]).groupBy("source").agg(
        (F.sum("n") - 1).alias("reached"), F.sum(F.col("n") * F.col("hops")).alias("total_distance")
    )
    share = F.try_divide(F.col("reached"), F.lit(nodes - 1))
    return sums.select(
        "source",
        "reached",
        "total_distance",
        F.coalesce(F.try_divide("reached", "total_distance") * share, F.lit(0.0)).alias("closeness"),
    )


def follow_chain(links: DataFrame, start: str, following: str, max_steps: int = V.CHAIN_STEPS) -> DataFrame:
    """``(start, chain, steps, ended)``: the nodes met from each start, at most ``max_steps`` on.

    ``ended`` is false where the chain was cut at that length.
    Chains of 1, 2, 4, ... steps are made by joining each with itself, and
    the wanted length is put together from those, so the number of joins
    grows with the logarithm of the length. ``start`` must be unique.
    """
    one = links.select(
        F.col(start).alias("start"),
        F.array_compact(F.array(following)).alias("chain"),
        F.col(following).alias("at"),
    )

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        more = second.select(F.col("start").alias("at"), F.col("chain").alias("rest"), F.col("at").alias("next_at"))
        moving = first.where("at IS NOT NULL").join(more, "at", "left")
        moved = moving.select(
            "start",
            F.concat("chain", F.coalesce("rest", F.array().cast(first.schema["chain"].dataType))).alias("chain"),
            F.col("next_at").alias("at"),
        )
        return moved.unionByName(first.where("at IS NULL"))

    power, result, left = one, None, max_steps
    while left:
        if left % 2:
            result = power if result is None else then(result, power)
        left //= 2
        if left:
            power = cut_lineage(then(power, power))
    if result is None:
        raise ValueError("max_steps must be at least 1")
    return result.select(
        "start",
        F.concat(F.array("start"), "chain").alias("chain"),
        F.size("chain").alias("steps"),
        (F.size("chain") < max_steps).alias("ended"),
    )


def path_text(path: Column, mark: str = ">") -> Column:
    return F.array_join(F.transform(path, lambda n: n.cast("string")), mark)
