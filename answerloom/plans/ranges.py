"""Ordered computations over groups of any size.

A plain window puts a whole group in one task. Here the rows are first dealt by ranges of the order that
hold about the same number of rows, so a group (or the whole table) is spread over many tasks:

1. the rows are range-partitioned and written once, with the number of their partition;
2. window inside (key, range);
3. one total per (key, range), and a window over those few totals;
4. total of the earlier ranges joined back to the rows.

When the input fits one range the plan is the plain window; results are the same either way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.plans.staging import cut_lineage

RANGE_BYTES = 64 * 1024 * 1024
_UNKNOWN_BYTES = 2**60  # what Catalyst says of data it knows nothing about
_GUESSED_VALUE_BYTES = 16

_COMBINE = {
    "sum": lambda before, here: F.coalesce(before + here, before, here),
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "min": lambda before, here: F.least(before, here),
    "max": lambda before, here: F.greatest(before, here),
}
_AGGREGATE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def plan_bytes(df: DataFrame) -> int:
    """Size estimate of a result: Catalyst's, but no more than all it reads.

    Catalyst multiplies the sides of a join, which says little about a join on keys.
    Where nothing is known (a micro-batch) the rows are counted.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = min(int(str(plan.stats().sizeInBytes())), read)
    return size if size < _UNKNOWN_BYTES else df.count() * _GUESSED_VALUE_BYTES * len(df.columns)


def range_count(df: DataFrame) -> int:
    return max(1, math.ceil(plan_bytes(df) / RANGE_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Input for work that is heavy per row, on every core.

    A table of many files comes in enough parts and is left alone. Only one
    with fewer parts than there are cores, and small enough for a shuffle to
    cost little, is dealt out again.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) > cores * RANGE_BYTES or len(df.inputFiles()) > cores // 2:
        return df
    return df.repartition(cores)


def in_ranges(df: DataFrame, order: Sequence[str], ranges: int, name: str = "__range") -> DataFrame:
    """The rows with the number of their range, from 0 in the order; rows of equal order share a range.

    Range partitioning is Spark's own. The rows are written once, so that the numbers hold for every later use.
    """
    return cut_lineage(df.repartitionByRange(ranges, *order).withColumn(name, F.spark_partition_id()))


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last n rows by a total order, in that order. Every task offers n rows at most."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def _with_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None) -> DataFrame | None:
    """Adds ``__key`` and ``__range``, or gives None when one range is enough.

    The key is one struct, which equals itself also where it holds nulls, so
    windows, totals and the join after them share one partitioning.
    """
    ranges = ranges or range_count(df)  # the whole rows move, not only their order
    if ranges == 1:
        return None
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return in_ranges(df, order, ranges).withColumn("__key", key)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    ranges: int | None = None,
) -> DataFrame:
    """Running ``sum``, ``count``, ``min`` or ``max`` up to and including each row.

    ``order`` is ascending and must be a total order inside a key. ``measures``
    maps an output name to (function, input column).
    """
    ranged = _with_range(df, keys, order, ranges)
    if ranged is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[_AGGREGATE[f](c).over(frame).alias(n) for n, (f, c) in measures.items()])
    frame = Window.partitionBy("__key", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.select("*", *[_AGGREGATE[f](c).over(frame).alias(f"__h_{n}") for n, (f, c) in measures.items()])
    totals = ranged.groupBy("__key", "__range").agg(
        *[_AGGREGATE[f](c).alias(f"__t_{n}") for n, (f, c) in measures.items()]
    )
    earlier = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    before = totals.select(
        "__key",
        "__range",
        *[merge[f](F.col(f"__t_{n}")).over(earlier).alias(f"__b_{n}") for n, (f, _) in measures.items()],
    )
    joined = rows.join(before, ["__key", "__range"], "left")
    return joined.select(
        *df.columns,
        *[_COMBINE[f](F.col(f"__b_{n}"), F.col(f"__h_{n}")).alias(n) for n, (f, _) in measures.items()],
    )


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    ahead: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Values of the previous (or next, ``ahead``) row of the same key."""
    shift = F.lead if ahead else F.lag
    ranged = _with_range(df, keys, order, ranges)
    if ranged is None:
        frame = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[shift(F.col(c)).over(frame).alias(n) for n, c in columns.items()])
    frame = Window.partitionBy("__key", "__range").orderBy(*order)
    rows = ranged.select(
        "*",
        shift(F.lit(True)).over(frame).alias("__inside"),
        *[shift(F.col(c)).over(frame).alias(f"__h_{n}") for n, c in columns.items()],
    )
    pick = F.min_by if ahead else F.max_by
    edge = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    edges = ranged.groupBy("__key", "__range").agg(pick(edge, F.struct(*order)).alias("__edge"))
    across = Window.partitionBy("__key").orderBy("__range")
    beyond = edges.select("__key", "__range", shift(F.col("__edge")).over(across).alias("__beyond"))
    joined = rows.join(beyond, ["__key", "__range"], "left")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col("__inside"), F.col(f"__h_{n}")).otherwise(F.col(f"__beyond.{n}")).alias(n)
            for n in columns
        ],
    )


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie_break: Sequence[str],
    tiles: int = 4,
    ranges: int | None = None,
) -> DataFrame:
    """Adds ``row_number``, ``rank``, ``dense_rank`` and ``ntile`` by ascending value.

    ``tie_break`` makes the order total; rank and dense_rank look at the value only.
    """
    ranges = ranges or range_count(df)
    if ranges == 1:
        by_value = Window.partitionBy(*keys).orderBy(value)
        by_row = Window.partitionBy(*keys).orderBy(value, *tie_break)
        return df.select(
            "*",
            F.row_number().over(by_row).cast("bigint").alias("row_number"),
            F.rank().over(by_value).cast("bigint").alias("rank"),
            F.dense_rank().over(by_value).cast("bigint").alias("dense_rank"),
            F.ntile(tiles).over(by_row).cast("bigint").alias("ntile"),
        )
    numbered = running(df, keys, [value, *tie_break], {"row_number": ("count", F.lit(1))}, ranges)
    numbered = cut_lineage(numbered)  # read three times
    levels = numbered.groupBy(*keys, value).agg(F.min("row_number").alias("rank"))
    levels = running(levels, keys, [value], {"dense_rank": ("count", F.lit(1))}, ranges)
    levels = levels.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), "rank", "dense_rank"
    )
    sizes = numbered.groupBy(*keys).agg(F.max("row_number").alias("__size"))
    sizes = sizes.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)], "__size")
    match = F.col(value).eqNullSafe(F.col("__v"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        same = same & F.col(k).eqNullSafe(F.col(f"__s{i}"))
    small = F.floor(F.col("__size") / tiles)
    wide = F.col("__size") - small * tiles  # that many tiles hold one row more
    at = F.col("row_number") - 1
    tile = F.when(at < wide * (small + 1), F.floor(at / (small + 1))).otherwise(
        wide + F.floor((at - wide * (small + 1)) / F.greatest(small, F.lit(1)))
    )
    return (
        numbered.join(levels, match, "inner")
        .join(sizes, same, "inner")
        .select(*df.columns, "row_number", "rank", "dense_rank", (tile + 1).cast("bigint").alias("ntile"))
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], ranges: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles per key. Equal values are counted before any row moves."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counts, keys, [value], {"__upto": ("sum", F.col("__n"))}, ranges)
    sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("__size"))
    if keys:
        sizes = sizes.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)], "__size")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__s{i}"))
        upto = upto.join(sizes, same)
    else:
        upto = upto.withColumn("__size", sizes.scalar())
    first, last = F.col("__upto") - F.col("__n"), F.col("__upto") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= last), F.col(value)))

    out = []
    for name, p in probabilities.items():
        place = (F.col("__size") - 1) * F.lit(p)
        low = F.floor(place)
        out += [
            at(low).alias(f"__lo_{name}"),
            at(F.ceil(place)).alias(f"__hi_{name}"),
            F.max(place - low).alias(f"__part_{name}"),
        ]
    edges = upto.groupBy(*keys).agg(*out)
    return edges.select(
        *keys,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}")).alias(n)
            for n in probabilities
        ],
    )
