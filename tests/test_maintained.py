"""Aggregates kept current from changes, and table functions in SQL, against plain versions."""

import datetime as dt
import random
from collections import Counter

import pytest

from answerloom.operators import maintained
from answerloom.operators.table_functions import sql_with_functions, step_runs

SCHEMA = "k string, v bigint"


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_full_computation(spark, seed):
    """Inserts, deletes, updates; nulls; groups that come, go, lose their least or most, or all known values; empty batches."""
    pick = random.Random(seed)
    row = lambda: (pick.choice(["a", "a", "b", "c", None, f"z{pick.randrange(6)}"]), pick.choice([None, *range(-5, 6)]))
    rows = [row() for _ in range(40)]
    now = maintained.aggregated(spark.createDataFrame(rows, SCHEMA), ["k"], "v")
    for size in (12, 0, 30):
        gone = pick.sample(rows, min(size, len(rows)))
        come = [row() for _ in range(size // 2)]
        for r in gone:
            rows.remove(r)
        rows = rows + come
        after = spark.createDataFrame(rows, SCHEMA)
        changes = spark.createDataFrame([(*r, 1) for r in come] + [(*r, -1) for r in gone], SCHEMA + ", sign int")
        now = maintained.apply_changes(now, changes, after, ["k"], "v")
        now = spark.createDataFrame(now.collect(), now.schema)  # as a table of its own, as on disk
        want = maintained.aggregated(after, ["k"], "v")
        assert now.columns == want.columns
        assert Counter(map(tuple, now.collect())) == Counter(map(tuple, want.collect()))
    assert {r.k: r.mean for r in maintained.with_mean(now).collect()} == {r.k: r.total / r.known if r.known else None for r in now.collect()}


def test_table_function(spark):
    pick = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(pick.choice([1, 1, 1, 2, None]), start + dt.timedelta(seconds=k), pick.choice(["x", "x", "x", "y", None])) for k in range(25_000)]
    df = spark.createDataFrame(rows, "session bigint, at timestamp_ntz, step string")
    sql = "SELECT * FROM step_runs(TABLE(t) PARTITION BY session ORDER BY at)"
    want, last = [], {}
    for s, at, step in rows:
        if s in last and last[s][2] == step:
            last[s][4], last[s][5] = at, last[s][5] + 1
        else:
            last[s] = [s, last[s][1] + 1 if s in last else 1, step, at, at, 1]
            want.append(last[s])
    assert Counter(map(tuple, sql_with_functions(spark, {"t": df}, {"step_runs": step_runs()}, sql).collect())) == Counter(map(tuple, want))
    assert sql_with_functions(spark, {"t": df.limit(0)}, {"step_runs": step_runs()}, sql).count() == 0
    assert not spark.catalog.functionExists("step_runs")
    spark.udtf.register("taken", step_runs())
    with pytest.raises(ValueError, match="taken"):
        sql_with_functions(spark, {"t": df}, {"taken": step_runs()}, "SELECT 1")
    spark.sql("DROP TEMPORARY FUNCTION taken")


def test_table_function_with_many_groups_in_an_instance(spark):
    """Groups that follow each other in a partition are numbered anew, also where a batch ends inside one, and null ones."""
    pick = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(pick.choice([1, 2**60 + 1, None]), k // 9000, start + dt.timedelta(seconds=k), pick.choice(["x", "x", "x", "y", None])) for k in range(27_000)]
    rows += [(s, 9, start, "x") for s in range(10, 3000)]
    df = spark.createDataFrame(rows, "session bigint, day int, at timestamp_ntz, step string")
    sql = "SELECT * FROM step_runs(TABLE(SELECT *, 0 AS part FROM t) PARTITION BY part ORDER BY (session, day, at))"
    want, last = [], {}
    for s, day, at, step in rows:
        g = (s, day)
        if g in last and last[g][2] == step:
            last[g][4], last[g][5] = at, last[g][5] + 1
        else:
            last[g] = [s, last[g][1] + 1 if g in last else 1, step, at, at, 1]
            want.append(last[g])
    got = sql_with_functions(spark, {"t": df}, {"step_runs": step_runs("session", "day")}, sql)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want))
