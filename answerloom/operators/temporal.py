"""Joins and windows over time: last earlier row, overlapping intervals, sessions by gap, sliding windows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.plans.ranges import neighbour, range_count, running
from answerloom.plans.staging import cut_lineage


def as_of_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, ties: Sequence[str] = (), prefix: str = "last_", ranges: int | None = None
) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` of the same keys that is not later.

    The right side's columns, but for the keys, come back with ``prefix``; they are null where there is no such row. A right row of the same
    time counts; of several at one time the greatest by ``ties`` does (without ties, by all its columns). Null keys and null times match
    nothing; every left row stays, also repeated ones. Left columns that begin with ``prefix`` and bear
    a right column's name would clash and raise.

    Both sides are put in one order and the last right row is carried forward as a running maximum, which is cut in ranges of time, so
    a key with most rows is spread over all of them, and no row of one side meets more than one of the other.
    """
    brought = [c for c in right.columns if c not in keys]
    names = [f"{prefix}{c}" for c in brought]
    clash = set(names) & set(left.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are on both sides")
    first = [right_time, *ties]
    ordered = first + [c for c in brought if c not in first]
    value = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(ordered)])
    known = F.lit(True)
    for c in (*keys, right_time):
        known = known & F.col(c).isNotNull()
    own = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(left.columns)])
    at_keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    keyed = [f"__k{i}" for i in range(len(keys))]
    rows = left.select(*at_keys, F.col(left_time).alias("__at"), F.lit(1).alias("__side"), own.alias("__own"))
    rights = right.where(known).select(*at_keys, F.col(right_time).alias("__at"), F.lit(0).alias("__side"), value.alias("__value"))
    both = rights.unionByName(rows, allowMissingColumns=True)
    carried = running(both, keyed, ["__at", "__side"], {"__last": ("max", F.col("__value"))}, ranges)
    at = {c: F.col(f"__last.v{i}") for i, c in enumerate(ordered)}
    return carried.where("__side = 1").select(*[F.col(f"__own.c{i}").alias(c) for i, c in enumerate(left.columns)], *[at[c].alias(n) for c, n in zip(brought, names)])


def interval_join(
    left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], width: float, keys: Sequence[str] = (), closed: bool = False
) -> DataFrame:
    """Pairs of rows whose intervals [low, high) overlap and whose ``keys`` are equal; each pair once.

    Ends that only touch do not overlap, unless ``closed`` makes both ends part of the interval. An interval that is empty (turned
    round, or of no length unless closed), or has a null or NaN end, meets nothing; null keys are not equal. The sides must not share names
    but for the keys.

    Intervals are listed under the cells they touch, so the condition becomes an equality join, and a pair counts only in the cell in
    which the later one starts. Cells come in sizes ``width * 2 ** level``: an interval's own level is the smallest at which it
    touches two cells at most, and a pair meets at the larger of its levels. A long interval is thus
    listed twice per level in use, never under each small cell. ``width`` is about the length of a usual interval.
    """
    keyed = list(keys)

    def ready(df: DataFrame, low: str, high: str, side: str) -> DataFrame:
        a, b = F.col(low).cast("double"), F.col(high).cast("double")
        inside = ~F.isnan(a) & ~F.isnan(b) & ((a <= b) if closed else (a < b))
        level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((b - a) / width, F.lit(1.0))))).cast("int")
        return df.where(inside).withColumns({f"__{side}_low": a, f"__{side}_high": b, f"__{side}_level": level})

    l_rows, r_rows = ready(left, *left_ends, "l"), ready(right, *right_ends, "r")
    used = l_rows.select(F.col("__l_level").alias("level")).unionByName(r_rows.select(F.col("__r_level").alias("level"))).distinct()
    levels = sorted(r.level for r in used.limit(2100).collect())  # a double has no more powers of two than that

    def listed(rows: DataFrame, side: str) -> DataFrame:
        low, high = F.col(f"__{side}_low"), F.col(f"__{side}_high")
        every = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(width * 2.0**n).alias("size")) for n in levels]) if levels else F.array().cast("array<struct<level:int,size:double>>")
        fitting = F.filter(every, lambda x: x["level"] >= F.col(f"__{side}_level"))
        cells = F.flatten(F.transform(fitting, lambda x: F.transform(F.sequence(F.floor(low / x["size"]), F.floor(high / x["size"])), lambda c: F.struct(x["level"].alias("l"), c.alias("c")))))
        return rows.withColumn("__cell", F.explode(cells)).withColumns({"__level": F.col("__cell.l"), "__at": F.col("__cell.c")}).drop("__cell")

    joined = listed(l_rows, "l").join(listed(r_rows, "r"), [*keyed, "__level", "__at"])
    later = F.greatest("__l_low", "__r_low")
    earlier_end = F.least("__l_high", "__r_high")
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__level"))
    counts = (F.col("__level") == F.greatest("__l_level", "__r_level")) & (F.col("__at") == F.floor(later / size))
    met = joined.where(counts & ((later <= earlier_end) if closed else (later < earlier_end)))
    return met.drop("__level", "__at", *(f"__{s}_{c}" for s in "lr" for c in ("low", "high", "level")))


#: An inner cell of ranks holds this many cells of the level below, as a power of two.
_CELL_BITS = 2


def _cell(rank: Column, level: Column) -> Column:
    return F.call_function("shiftright", rank, level * _CELL_BITS)


def _cells_of_range(first: Column, last: Column, levels: int) -> Column:
    """The fewest cells (level, at) that make up the ranks from first to last, which are 1 at least; none when first > last."""

    def inside(level: Column) -> tuple[Column, Column]:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), level * _CELL_BITS)
        return _cell(first + width - 1, level), _cell(last + 1, level) - 1

    def listed(level: Column) -> Column:
        (a, b), (c, d) = inside(level), inside(level + 1)
        # Only up to a cell's worth of cells at each end is not in a larger one.
        ends = F.array_distinct(F.concat(F.sequence(a, F.least(b, a + (1 << _CELL_BITS))), F.sequence(F.greatest(a, b - (1 << _CELL_BITS)), b)))
        edge = F.filter(ends, lambda x: ~F.shiftright(x, _CELL_BITS).between(c, d))
        cells = F.when(a <= b, edge).otherwise(F.array().cast("array<bigint>"))
        return F.transform(cells, lambda x: F.struct(level.alias("level"), x.alias("at")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), listed))


def _cells_of_point(rank: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda n: F.struct(n.alias("level"), _cell(rank, n).alias("at")))


def overlap_totals(
    left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], measures: Mapping[str, tuple[str, Column]], closed: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Each row of ``left`` that some interval of ``right`` overlaps, with ``measures`` (name to (``count``, ``sum``, ``min`` or ``max``, right column)) of those.

    What overlaps is as in ``interval_join``, but pairs are never made, so the work does not grow with their number. The ends become
    ranks. A right interval overlaps if it starts inside the left one, or else if the left one starts inside it after its own
    start. Both say that a rank lies in a range of ranks: a rank lies in one cell per level, a range is made up of a few cells
    per level, so each meets its cells by equality, after rows of a cell have been added up. Rows with equal ends are one.
    """
    made = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    again = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    names = [f"__m{i}" for i in range(len(measures))]
    functions = [f for f, _ in measures.values()]

    def together() -> list[Column]:
        return [again[f](n).alias(n) for f, n in zip(functions, names)]

    def ready(df: DataFrame, low: str, high: str) -> DataFrame:
        a, b = (F.col(c).cast("double") + F.lit(0.0) for c in (low, high))  # one zero
        return df.withColumns({"__low": a, "__high": b}).where(~F.isnan("__low") & ~F.isnan("__high") & (F.col("__low") <= F.col("__high") if closed else F.col("__low") < F.col("__high")))

    l_rows = ready(left, *left_ends)
    r_rows = cut_lineage(ready(right, *right_ends).groupBy("__low", "__high").agg(*[made[f](c).alias(n) for n, (f, c) in zip(names, measures.values())]))
    l_once = cut_lineage(l_rows.select("__low", "__high").distinct())
    ends = l_once.select(F.explode(F.array("__low", "__high")).alias("end")).unionByName(r_rows.select(F.explode(F.array("__low", "__high")).alias("end"))).distinct()
    ranks = cut_lineage(running(ends, [], ["end"], {"rank": ("count", F.lit(1))}, ranges))
    levels = max(1, math.ceil(ranks.count().bit_length() / _CELL_BITS))

    def ranked(rows: DataFrame) -> DataFrame:
        first = ranks.select(F.col("end").alias("__low"), F.col("rank").alias("__first"))
        last = ranks.select(F.col("end").alias("__high"), F.col("rank").alias("__last"))
        joined = rows.join(first, "__low").join(last, "__high")
        return joined if closed else joined.withColumn("__last", F.col("__last") - 1)  # the last rank before the end

    def listed(rows: DataFrame, starts: Column, holds: Column, *kept: str) -> DataFrame:
        """Cells of two kinds: of the rows as starting points or, for the other side, as ranges that hold such."""
        kinds = F.concat(
            F.transform(starts, lambda c: F.struct(F.lit(0).alias("kind"), c["level"].alias("level"), c["at"].alias("at"))),
            F.transform(holds, lambda c: F.struct(F.lit(1).alias("kind"), c["level"].alias("level"), c["at"].alias("at"))),
        )
        return rows.select(*kept, F.explode(kinds).alias("__cell")).select(*kept, "__cell.*")

    first, last = F.col("__first"), F.col("__last")
    cells = listed(ranked(r_rows), _cells_of_point(first, levels), _cells_of_range(first + 1, last, levels), *names)
    cells = cut_lineage(cells.groupBy("kind", "level", "at").agg(*together()))
    asked = listed(ranked(l_once), _cells_of_range(first, last, levels), _cells_of_point(first, levels), "__low", "__high")
    totals = asked.join(cells, ["kind", "level", "at"]).groupBy("__low", "__high").agg(*together())
    return l_rows.join(totals, ["__low", "__high"]).select(*left.columns, *[F.col(n).alias(m) for n, m in zip(names, measures)])


def gap_sessions(
    df: DataFrame, keys: Sequence[str], time: str, gap_seconds: float, measures: Mapping[str, Column], order: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Per key its sessions: runs of rows no more than ``gap_seconds`` apart, with start, end (the last time), and ``measures``.

    Rows of null time belong to no session; null keys are a key. Columns: keys, session_no (from 1 in time), session_start, session_end, measures.
    The gap before each row comes from its neighbour and sessions are numbered by a running count of the gaps, both cut in ranges of
    time: neither a key nor a session, however long, is one task's work, and sessions are added up before they are shuffled.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    ordered = ["__at", *order]
    slim = df.where(F.col(time).isNotNull()).withColumn("__at", at)
    parts = ranges or range_count(slim)
    before = neighbour(slim, keys, ordered, {"__before": "__at"}, ranges=parts)
    opens = F.when(F.col("__before").isNull() | (F.col("__at") - F.col("__before") > F.lit(int(gap_seconds * 1_000_000))), 1).otherwise(0)
    marked = before.withColumn("__opens", opens)
    numbered = running(cut_lineage(marked) if parts > 1 else marked, keys, ordered, {"session_no": ("sum", F.col("__opens"))}, parts)
    made = numbered.groupBy(*keys, "session_no").agg(
        F.min(time).alias("session_start"), F.max(time).alias("session_end"), *[m.alias(n) for n, m in measures.items()]
    )
    return made


def sliding_windows(df: DataFrame, keys: Sequence[str], time: str, length_seconds: int, slide_seconds: int, sums: Mapping[str, Column], delay: str | None = None) -> DataFrame:
    """Sums per key and sliding window: keys, window_start, window_end, and a column for each of ``sums`` (values to add up).

    Rows are added up once in panes as long as the greatest common divisor of length and slide, before any shuffle; only the panes
    are copied into the windows they lie in, so a row is never multiplied by length / slide. Windows start at multiples of the slide since
    the epoch; the slide is no longer than the window. Null times lie in no window, null keys are a key. The same expression works on a stream, given its ``delay``, in append
    mode: a window comes out once, when the watermark has passed its end, and rows later than the delay are dropped.
    """
    if not 0 < slide_seconds <= length_seconds:
        raise ValueError("the slide must be positive and no longer than the window")
    pane = math.gcd(length_seconds, slide_seconds)
    timed = df.withColumn("__at", F.col(time).cast("timestamp")).where("__at is not null")
    if delay is not None:
        timed = timed.withWatermark("__at", delay)
    panes = timed.groupBy(*keys, F.window("__at", f"{pane} seconds").alias("__pane")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    windows = F.window("__pane", f"{length_seconds} seconds", f"{slide_seconds} seconds").alias("__window")
    whole = panes.groupBy(*keys, windows).agg(*[F.sum(n).alias(n) for n in sums])
    return whole.select(*keys, F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *sums)
