"""SQL over named tables, and the relational shapes that need care at scale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sql_query(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """Run SQL over tables by name. The names are used as they are, never rewritten.

    Temporary views of the session with these names are as before when the query has been analysed.
    """
    names = {name.lower() for name in tables}
    own = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name.lower() in names}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, df in own.items():
            df.createOrReplaceTempView(name)


def scalar_answer(df: DataFrame) -> Any:
    """The value of a one-by-one result, else the result itself."""
    rows = df.take(2) if len(df.columns) == 1 else []
    return rows[0][0] if len(rows) == 1 else df


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key with their ``place``; k rows per task and key reach the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def band_join(df: DataFrame, value: str, bands: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Rows with the bands they fall in (low <= value < high).

    A band is listed under every cell of the given width it touches, a value
    under its own cell, so the range condition becomes an equality join.
    """
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    listed = bands.withColumn("__cell", F.explode(cells))
    placed = df.withColumn("__cell", F.floor(F.col(value) / width))
    inside = (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))
    return placed.join(listed, "__cell").where(inside).drop("__cell")


def moving_average(df: DataFrame, keys: Sequence[str], period: Column, measure: str, span: int) -> DataFrame:
    """Total per period and key, running total, and mean of the last ``span`` periods present.

    Rows are added up per period first, so a window holds one row per period.
    """
    daily = df.groupBy(*keys, period.alias("period")).agg(F.sum(measure).alias("total"))
    by_time = Window.partitionBy(*keys).orderBy("period")
    return daily.select(
        "*",
        F.sum("total").over(by_time.rowsBetween(Window.unboundedPreceding, 0)).alias("running_total"),
        F.avg("total").over(by_time.rowsBetween(1 - span, 0)).alias("moving_average"),
    )
