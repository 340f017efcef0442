"""Registered queries: one per operator, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from answerloom.plans import ranges
from answerloom.plans.ranges import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row."""
    return spread(table(spark, sf_dir, name))


def _in_many_ranges(name: str) -> Query:
    """The query with its ordered computations cut in ranges, as on a table of many GB."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counted, ranges.range_count = ranges.range_count, lambda df: 24
        try:
            return QUERIES[name](spark, sf_dir)
        finally:
            ranges.range_count = counted

    return run


def load_all() -> None:
    from catalog import (  # noqa: F401
        flagship,
        q_aggregates,
        q_answers,
        q_charts,
        q_graph,
        q_layout,
        q_pages,
        q_prepare,
        q_questions,
        q_relational,
        q_sessions,
        q_sources,
        q_temporal,
    )

    ordered = ("A3_", "A13_", "Q6_", "Q7_", "S9_to_json", "T1_", "T2_", "T3_", "V4_")
    for name in [n for n in QUERIES if n.startswith(ordered)]:
        QUERIES[f"{name}_in_ranges"] = _in_many_ranges(name)
        ORACLES[f"{name}_in_ranges"] = ORACLES[name]
