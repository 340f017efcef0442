"""Table functions that SQL can call, one instance per partition of their table argument."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf

from answerloom.operators.relational import sql_query


def _turns(rows: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """For each row but the first whether one of the columns differs from the row before; nulls are equal to each other."""
    found = np.zeros(rows.num_rows - 1, dtype=bool)
    for name in columns:
        coded = rows.column(name).dictionary_encode(null_encoding="encode").indices
        found |= np.diff(coded.to_numpy(zero_copy_only=False)) != 0
    return found


class _StepRuns:
    """Runs of equal steps in the order of a partition: a row per run, whatever batches the rows come in.

    The table argument has the columns session, at and step. Null steps are equal to each other. Runs end, and are numbered anew, where
    one of ``groups`` changes; without groups a partition is one. Only the run at the end of a batch is held, so a partition of any
    size goes through in batches.
    """

    groups: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.open, self.group = None, None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if not rows.num_rows:
            return
        anew = _turns(rows, self.groups)
        starts = np.append(0, np.flatnonzero(anew | _turns(rows, ["step"])) + 1)
        ends = np.append(starts[1:] - 1, rows.num_rows - 1)
        place = np.arange(len(starts))
        first_of_group = np.maximum.accumulate(np.where(np.append(True, anew[starts[1:] - 1]), place, 0))
        number = place - first_of_group + 1
        value = lambda name, at: rows.column(name)[at].as_py()
        goes_on = self.open is not None and self.group == [value(g, 0) for g in self.groups]
        held = self.open.to_pylist()[0] if goes_on else None
        same = goes_on and held["step"] == value("step", 0)
        if goes_on:
            number[first_of_group == 0] += held["run"] - same
        column = lambda name, at, kind: rows.column(name).take(pa.array(at)).cast(kind)
        runs = pa.table(
            {
                "session": column("session", starts, pa.int64()),
                "run": pa.array(number, pa.int64()),
                "step": column("step", starts, pa.string()),
                "first_at": column("at", starts, pa.timestamp("us")),
                "last_at": column("at", ends, pa.timestamp("us")),
                "steps": pa.array(ends - starts + 1, pa.int64()),
            }
        )
        if same:
            met = runs.slice(0, 1).to_pylist()[0]
            longer = held | {"last_at": met["last_at"], "steps": held["steps"] + met["steps"]}
            runs = pa.concat_tables([pa.Table.from_pylist([longer], runs.schema), runs.slice(1)])
        elif self.open is not None:
            runs = pa.concat_tables([self.open, runs])
        self.open, self.group = runs.slice(runs.num_rows - 1), [value(g, rows.num_rows - 1) for g in self.groups]
        yield runs.slice(0, runs.num_rows - 1)

    def terminate(self) -> Iterator[pa.Table]:
        if self.open is not None:
            yield self.open


def step_runs(*groups: str):
    """``step_runs(TABLE(...) PARTITION BY session ORDER BY at)``: session, run, step, first_at, last_at, steps.

    Starting an instance costs far more than a row. With ``groups`` a partition may hold many groups one after another: partition by a
    hash of them, and order by them first.
    """
    function = type("_GroupedStepRuns", (_StepRuns,), {"groups": groups}) if groups else _StepRuns
    return arrow_udtf(function, returnType="session bigint, run bigint, step string, first_at timestamp_ntz, last_at timestamp_ntz, steps bigint")


@contextmanager
def registered(spark: SparkSession, functions: Mapping[str, Any]) -> Iterator[None]:
    """Table functions under their names while a query is analysed; a name that is taken raises."""
    taken = [n for n in functions if spark.catalog.functionExists(n)]
    if taken:
        raise ValueError(f"functions {taken} exist")
    try:
        for name, function in functions.items():
            spark.udtf.register(name, function)
        yield
    finally:
        for name in functions:
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def sql_with_functions(spark: SparkSession, tables: Mapping[str, DataFrame], functions: Mapping[str, Any], sql: str) -> DataFrame:
    """``sql_query`` with table functions of one's own. Spark shuffles the table argument by its PARTITION BY and sorts it.

    A partition is one instance's work: partition by something bounded, such as a hash of a session's day. Partitions of null keys are
    partitions; a table without rows has none.
    """
    with registered(spark, functions):
        return sql_query(spark, tables, sql)
