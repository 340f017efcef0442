"""The numbers behind a chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.plans.ranges import running


def bar_data(df: DataFrame, key: str, measure: str) -> DataFrame:
    """One value per category, highest first."""
    return df.groupBy(key).agg(F.sum(measure).alias("value")).orderBy(F.desc("value"), key)


def scatter_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y over x per group."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def histogram_data(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins, the last one closed, empty ones with count 0."""
    value = F.col(column).cast("double")
    present = df.where(value.isNotNull() & ~F.isnan(value)).select(value.alias("v"))
    edges = present.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("e")).scalar()
    ranged = present.withColumn("e", edges)
    width = F.col("e.hi") - F.col("e.lo")
    place = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col("v") - F.col("e.lo")) / width * bins), F.lit(bins - 1))
    )
    counts = ranged.groupBy(place.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("e", edges)
    step = (F.col("e.hi") - F.col("e.lo")) / bins
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.col("e.lo") + step * F.col("bin")).alias("low"),
        (F.col("e.lo") + step * (F.col("bin") + 1)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def cumulative_line(df: DataFrame, time: str, period: str, measure: str, ranges: int | None = None) -> DataFrame:
    """Total per period of time and the running total."""
    totals = df.groupBy(F.date_trunc(period, time).cast("date").alias("period")).agg(F.sum(measure).alias("total"))
    return running(totals, [], ["period"], {"running_total": ("sum", F.col("total"))}, ranges)
