"""Merkle manifest of a dataset: a tree per source, a tree of the sources, and a proof for every row.

DataFrame functions only. A level of a tree is a slot pivot: conditional aggregates spread the children of each
parent into one column per slot; the columns end to end are hashed to the parent, and without the row's own slot
they are its siblings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.plans.ranges import in_ranges, range_count
from answerloom.plans.staging import cut_lineage

FANOUT = 3
SPAN = 6  # levels built between two exchanges: a block of FANOUT ** SPAN nodes lies in one task
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts end to end."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*(field(v) for v in values))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to: at each level the siblings to the left, the node, those to the right."""
    return F.aggregate(path, start, lambda node, step: digest(step["left"], node, step["right"]))


def siblings_digest(path: Column) -> Column:
    """H of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _numbered(df: DataFrame, key: str | None, order: Sequence[str], ties: Sequence[str], ranges: int) -> DataFrame:
    """Adds ``_mk_pos`` (from 0 within a key, in the order) and ``_mk_n`` (rows of the key).

    Rows are dealt by ranges of the order, counted inside (key, range), and moved up by the earlier ranges' counts,
    so a key of any size is spread over all ranges.
    """
    keys = [key] if key else []
    ranged = in_ranges(df, order, ranges, "_mk_range")
    counts = ranged.groupBy(*keys, "_mk_range").agg(F.count("*").alias("_mk_here"))
    earlier = Window.partitionBy(*keys).orderBy("_mk_range")  # one row per range
    counts = counts.select(
        *keys, "_mk_range", (F.sum("_mk_here").over(earlier) - F.col("_mk_here")).alias("_mk_before"), F.sum("_mk_here").over(Window.partitionBy(*keys)).alias("_mk_n")
    )
    inside = Window.partitionBy(*keys, "_mk_range").orderBy(*order, *ties)
    rows = ranged.withColumn("_mk_row", F.row_number().over(inside)).join(counts, [*keys, "_mk_range"])
    return rows.withColumn("_mk_pos", F.col("_mk_before") + F.col("_mk_row") - 1).drop("_mk_before", "_mk_row", "_mk_range")


def _climb(nodes: DataFrame, fanout: int, span: int) -> DataFrame:
    """``span`` levels up from (``_mk_key``, ``_mk_pos``, ``_mk_n``, ``_mk_node``): adds ``_mk_block``, ``_mk_top`` and ``_mk_path``.

    One exchange brings a block together. The groups of a level are prefixes of those of the level below,
    so a single sort serves the aggregates of all levels, and no group holds more rows than a block.
    """
    part = lambda j: F.expr(f"_mk_pos div {fanout**j}")
    rows = nodes.withColumns({f"_mk_p{j}": part(j) for j in range(1, span + 1)})
    rows = rows.repartition("_mk_key", f"_mk_p{span}").withColumn("_mk_h", _hex(F.col("_mk_node")))
    steps = []
    for j in range(1, span + 1):
        run = Window.partitionBy("_mk_key", *(f"_mk_p{i}" for i in range(span, j - 1, -1)))
        slot = F.expr(f"(_mk_pos div {fanout ** (j - 1)}) % {fanout}")
        several = F.expr(f"_mk_n > {fanout ** (j - 1)}")  # more than one node is left at the level below
        rows = rows.withColumns({f"_mk_c{s}": F.max(F.when(slot == s, F.col("_mk_h"))).over(run) for s in range(fanout)})
        child = [F.coalesce(f"_mk_c{s}", F.lit("")) for s in range(fanout)]
        others = lambda side: F.concat(F.lit(""), *(F.when(side(s, slot), child[s]).otherwise("") for s in range(fanout)))  # noqa: B023, E731
        step = F.struct(others(lambda s, own: F.lit(s) < own).alias("left"), others(lambda s, own: F.lit(s) > own).alias("right"))
        rows = rows.withColumns(
            {f"_mk_s{j}": F.when(several, step), "_mk_h": F.when(several, digest(*child)).otherwise(F.col("_mk_h"))}
        ).drop(*(f"_mk_c{s}" for s in range(fanout)))
        steps.append(f"_mk_s{j}")
    rows = rows.withColumns({"_mk_path": F.array_compact(F.array(*steps)), "_mk_block": F.col(f"_mk_p{span}"), "_mk_top": F.col("_mk_h")})
    return rows.drop(*steps, "_mk_h", *(f"_mk_p{j}" for j in range(1, span + 1)))


def _tree(nodes: DataFrame, fanout: int, span: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes``, each with the ``_mk_path`` up to its key's root and on, and what ``above`` knows of that root.

    ``above`` gets one row per key (``_mk_key``, ``_mk_node``) and returns ``_mk_key``, ``_mk_more`` (path from there)
    and columns of its own. Blocks are built upwards until each key has one; each round leaves 1 / fanout ** span
    of the rows. Then the paths come down, a join by block in every round.
    """
    size = fanout**span
    most = nodes.agg(F.max("_mk_n")).first()[0] or 0
    rounds = [nodes]
    while True:
        first = F.expr(f"_mk_pos % {size} = 0")
        up = _climb(rounds[-1].select("_mk_key", "_mk_pos", "_mk_n", "_mk_node"), fanout, span).where(first)
        up = up.select("_mk_key", F.col("_mk_block").alias("_mk_pos"), F.expr(f"(_mk_n + {size - 1}) div {size}").alias("_mk_n"), F.unhex("_mk_top").alias("_mk_node"))
        rounds.append(cut_lineage(up))
        most = -(-most // size)
        if most <= 1:
            break
    tops = above(rounds[-1].select("_mk_key", "_mk_node"))
    known = rounds[-1].select("_mk_key", "_mk_pos").join(tops, "_mk_key")
    for lower in reversed(rounds[:-1]):
        known = known.withColumnRenamed("_mk_pos", "_mk_block")
        known = _climb(lower, fanout, span).drop("_mk_top").join(known, ["_mk_key", "_mk_block"])
        known = known.withColumn("_mk_more", F.concat("_mk_path", "_mk_more")).drop("_mk_path", "_mk_block")
        if lower is not nodes:
            known = cut_lineage(known.drop("_mk_n", "_mk_node"))
    return known.drop("_mk_n", "_mk_node").withColumnRenamed("_mk_more", "_mk_path")


def prove(
    df: DataFrame, source: str, order: Sequence[str], leaf: str, subroot: str = "subroot", root: str = "root", path: str = "path",
    fanout: int = FANOUT, span: int = SPAN,
) -> DataFrame:
    """The rows of ``df`` with the ``subroot`` of their source, the ``root`` of all, and their ``path`` to it.

    ``leaf`` holds a row's lowercase hex digest. The leaves of a source ascend by ``order`` (nulls first; ties by leaf, so
    repeated rows are leaves each and the roots do not depend on the input's layout). While several nodes remain, each
    run of ``fanout`` (the last may be shorter, even one) becomes the sha256 of its hex digests end to end; a lone leaf is
    its own subroot. Subroots in order of source (null, which is a source of its own, first; then by UTF-8 bytes) make the root in the same
    way. A path has one (left, right) per level: the run's other digests on either side of the node, end to end.

    The text itself, however long, is only in the leaf and never moves. A source with most rows is numbered by ranges and built
    in blocks of ``fanout ** span`` nodes. Other columns are kept, whatever their names, but for those
    called like the results, which are replaced; names that begin with ``_mk_`` are ours. An empty table gives no rows.
    """
    df = df.drop(*({subroot, root, path} - {leaf, source, *order}))
    ranges = lambda d: max(range_count(d), int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = cut_lineage(df.withColumns({"_mk_key": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")), "_mk_node": F.unhex(leaf)}).drop(leaf))
    leaves = cut_lineage(_numbered(keyed, "_mk_key", list(order), ["_mk_node"], ranges(keyed)))

    def whole(top: DataFrame) -> DataFrame:
        return top.select("_mk_key", _hex(F.col("_mk_node")).alias("_mk_root"), F.from_json(F.lit("[]"), PATH).alias("_mk_more"))

    def over_sources(subroots: DataFrame) -> DataFrame:
        named = subroots.withColumnRenamed("_mk_key", "_mk_source")
        placed = _numbered(named, None, ["_mk_source"], [], ranges(named))
        placed = cut_lineage(placed.withColumns({"_mk_key": F.lit(0), "_mk_subroot": _hex(F.col("_mk_node"))}))
        tied = _tree(placed, fanout, span, whole)
        return cut_lineage(tied.select(F.col("_mk_source").alias("_mk_key"), "_mk_subroot", "_mk_root", F.col("_mk_path").alias("_mk_more")))

    out = _tree(leaves.withColumn("_mk_leaf", F.col("_mk_node")), fanout, span, over_sources)
    kept = [c for c in df.columns if c != leaf]
    return out.select(*kept, _hex(F.col("_mk_leaf")).alias(leaf), F.col("_mk_subroot").alias(subroot), F.col("_mk_root").alias(root), F.col("_mk_path").alias(path))
