"""Tables laid out in partitions, joined and changed without reading or writing the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.plans.staging import cut_lineage


def month_of(at: Column | str) -> Column:
    """The month of a date or time as text, ``2024-03``; null stays null."""
    return F.date_format(F.to_date(at), "yyyy-MM")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> DataFrame:
    """``df`` written in a folder per value of ``by`` below the new ``path``, and read back; ``by`` come last.

    Rows are dealt by ``by`` first, so a partition has few files; adaptive execution splits the partitions that hold most rows
    over several tasks and puts small ones together. Null is a partition of its own. An existing path raises.
    """
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    return partitioned(df, path, by)


def partitioned(like: DataFrame, path: str, by: Sequence[str]) -> DataFrame:
    """The table at ``path`` with the columns and types of ``like``; no type is guessed from a folder's name."""
    ordered = [*(c for c in like.columns if c not in by), *by]
    return like.sparkSession.read.schema(like.select(*ordered).schema).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> DataFrame:
    """Puts the partitions that ``df`` has rows of in place of those at ``path``; all others stay as they are.

    ``df`` holds whole partitions, changed or not, and may be made from the table itself: it is written to the shared folder
    first. A partition without rows in ``df`` is not touched, so one that loses its last row must be deleted by its user.
    """
    ordered = [*(c for c in df.columns if c not in by), *by]
    made = cut_lineage(df.select(*ordered))
    made.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return partitioned(df, path, by)


def pruned_join(facts: DataFrame, chosen: DataFrame, by: Sequence[str], condition: str | Column) -> DataFrame:
    """``facts``, partitioned by ``by``, with the rows of ``chosen`` that meet ``condition``; other partitions are not read.

    ``chosen`` is written first, so its size is known: where Spark then broadcasts it, its values prune the partitions of the scan at
    run time. A larger one is joined by a shuffle, with the same rows. Null partitions match nothing.
    """
    return facts.join(cut_lineage(chosen).where(condition), list(by))
