"""Aggregate tables kept current from batches of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def aggregated(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: n (rows), known (rows whose value is not null), total, least, most."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("known"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def apply_changes(current: DataFrame, changes: DataFrame, after: DataFrame, keys: Sequence[str], value: str, sign: str = "sign") -> DataFrame:
    """``aggregated`` of the table after a batch of changes, from that before it (``current``) and the changed rows alone.

    ``changes`` holds inserted rows with ``sign`` 1 and deleted ones with -1 (an update is both); ``after`` is the table after the
    batch. Counts and totals add up signed deltas, summed before the shuffle; ``mean`` is total / known. A new least or most value
    comes from the inserted rows, unless a deleted row held the old one: only those groups are worked out again, from ``after``, which is read
    for nothing else. Groups without rows go; null keys are a key; a group without known values has null results. Totals are exact
    for whole numbers and decimals; those of floating values can differ from a full computation in the last digits. A batch without rows changes nothing.
    """
    inserted, deleted = F.col(sign) > 0, F.col(sign) < 0
    delta = changes.groupBy(*keys).agg(
        F.sum(sign).alias("d_n"),
        F.sum(F.when(F.col(value).isNotNull(), F.col(sign)).otherwise(0)).alias("d_known"),
        F.sum(F.col(value) * F.col(sign)).alias("d_total"),
        F.min(F.when(inserted, F.col(value))).alias("in_least"), F.max(F.when(inserted, F.col(value))).alias("in_most"),
        F.min(F.when(deleted, F.col(value))).alias("out_least"), F.max(F.when(deleted, F.col(value))).alias("out_most"),
    )
    kinds = {f.name: f.dataType for f in current.schema}
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = current.alias("c").join(delta.alias("d"), _same("c", "d", keys), "full")
    known = zero(F.col("c.known")) + zero(F.col("d.d_known"))
    total = F.when(known > 0, zero(F.col("c.total")) + zero(F.col("d.d_total")))
    lost = (F.col("d.out_least") <= F.col("c.least")) | (F.col("d.out_most") >= F.col("c.most")) | (F.col("c.known").isNull() & F.col("d.out_least").isNotNull())
    found = F.col("c.n").isNotNull()
    merged = both.select(
        *[F.when(found, F.col(f"c.{k}")).otherwise(F.col(f"d.{k}")).alias(k) for k in keys],
        (zero(F.col("c.n")) + zero(F.col("d.d_n"))).cast(kinds["n"]).alias("n"), known.cast(kinds["known"]).alias("known"), total.cast(kinds["total"]).alias("total"),
        F.least("c.least", "d.in_least").alias("least"), F.greatest("c.most", "d.in_most").alias("most"),
        (F.coalesce(lost, F.lit(False)) & (known > 0)).alias("__lost"), (known == 0).alias("__none"),
    ).where("n > 0")
    again = merged.where("__lost").select(*keys)
    rows = after.select(*keys, F.col(value).alias("__value")).alias("a").join(again.alias("g"), _same("a", "g", keys), "left_semi")
    ends = rows.groupBy(*keys).agg(F.min("__value").alias("new_least"), F.max("__value").alias("new_most"))
    whole = merged.alias("m").join(ends.alias("e"), _same("m", "e", keys), "left")
    end = lambda c: F.when(F.col("m.__none"), None).when(F.col("m.__lost"), F.col(f"e.new_{c}")).otherwise(F.col(f"m.{c}")).cast(kinds[c]).alias(c)
    return whole.select(*[F.col(f"m.{k}").alias(k) for k in keys], "m.n", "m.known", "m.total", end("least"), end("most"))


def with_mean(table: DataFrame) -> DataFrame:
    return table.withColumn("mean", F.col("total") / F.col("known"))
