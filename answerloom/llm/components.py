"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.plans.staging import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): its component's smallest node.

    Large-star and small-star rounds in turn: every node's larger, then smaller, neighbours are tied to its
    smallest one. Rounds grow with the logarithm of the longest path; each is written to the shared
    folder. Edges of a node to itself keep it in the result.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null").distinct()
    pairs = cut_lineage(pairs)
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    now = pairs.where("a < b")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        smaller = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(smaller, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        small = small.unionByName(smaller.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        now = cut_lineage(small)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    found = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    roots = now.select(F.col("a").alias("node")).unionByName(loops).distinct().select("node", F.col("node").alias("root"))
    return found.unionByName(roots.join(found, "node", "left_anti"))
