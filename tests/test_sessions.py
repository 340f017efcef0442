import datetime as dt

import pytest
from pyspark.sql import functions as F

from answerloom.operators import charts as C
from answerloom.operators import relational as R
from answerloom.operators import sessions as S
from answerloom.streaming import rollups


@pytest.fixture(scope="module")
def events(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else f"u{i % 4}", start + dt.timedelta(seconds=7 * i), "error" if i % 5 == 0 else "step", i % 11)
            for i in range(600)]
    return spark.createDataFrame(rows, "id bigint, s string, ts timestamp_ntz, step string, tokens bigint").cache()


def test_rollup(events):
    got = {r.s: r for r in S.audit_rollup(events, "s", "ts", "step").collect()}
    rows = [r for r in events.collect() if r.s == "hot"]
    assert (got["hot"].steps, got["hot"].errors) == (400, sum(r.step == "error" for r in rows))
    assert got["hot"].elapsed == (rows[-1].ts - rows[0].ts).total_seconds()


@pytest.mark.parametrize("ranges", [1, 5])
def test_steps_keep_order(events, ranges):
    got = S.audit_steps(events, "s", ["ts", "id"], "step", ranges).where("s = 'hot'").orderBy("step_no").collect()
    assert [r.step for r in got] == [r.step for r in events.where("s = 'hot'").orderBy("id").collect()]
    assert [r.step_no for r in got] == list(range(1, 401))


@pytest.mark.parametrize("ranges", [1, 5])
def test_deadline(events, ranges):
    got = S.deadline_status(events, "s", "ts", ["ts", "id"], F.col("step") == "error", ranges=ranges)
    clock: dict = {}
    for r in got.orderBy("id").collect():
        if r.s not in clock or r.step == "error":
            clock[r.s] = r.ts
        safe = max(0, 180 - (r.ts - clock[r.s]).total_seconds() - 10)
        assert (r.safe_seconds, r.critical) == (safe, safe <= 5)


def test_budget(events):
    got = S.token_budget(events, "s", ["ts", "id"], "tokens", budget=1000, ranges=4).where("s = 'hot'").orderBy("id").collect()
    used = 0
    for r in got:
        used += r.tokens
        assert (r.used, r.share, r.switched) == (used, used / 1000, used >= 750)
    assert S.token_budget(events, "s", ["ts", "id"], "tokens", budget=0).where("NOT switched").count() == 0


def in_parts(spark, events, path, parts, process):
    for p in range(parts):
        events.where(f"id >= {600 * p // parts} AND id < {600 * (p + 1) // parts}").write.mode("append").parquet(path)
        process(rollups.event_stream(spark, path, events.schema))


def test_stream_rollup_equals_batch(spark, events, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    rolled = lambda df: rollups.stream_audit_rollup(df, "s", "ts", "step", "10 minutes", "5 minutes")
    in_parts(spark, events, str(tmp_path / "in"), 3, lambda s: rollups.run_update(rolled(s), out, mark))
    got, want = rollups.latest_rows(spark, out, ["s", "window_start", "window_end"]), rolled(events)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_stream_append_gives_closed_windows_once(spark, events, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    rolled = lambda df: rollups.stream_audit_rollup(df, "s", "ts", "step", "10 minutes", "5 minutes")
    in_parts(spark, events, str(tmp_path / "in"), 3, lambda s: rollups.run_append(rolled(s), out, mark))
    last = events.agg(F.max("ts")).first()[0].replace(tzinfo=None) - dt.timedelta(minutes=5)
    want = rolled(events).where(F.col("window_end") <= F.lit(last.isoformat(" ")).cast("timestamp"))
    got = spark.read.parquet(out)
    assert want.count() > 0
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_budget_equals_batch(spark, events, tmp_path, parts):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda s: rollups.run_token_budget(s, "s", ["ts", "id"], "tokens", out, mark, budget=300, ranges=3)
    in_parts(spark, events, str(tmp_path / "in"), parts, run)
    batch = S.token_budget(events, "s", ["ts", "id"], "tokens", budget=300).where("switched")
    want = sorted((r.s, r.id, r.used) for r in batch.groupBy("s").agg(F.min_by(F.struct("id", "used"), "id").alias("f")).select("s", "f.*").collect())
    got = spark.read.parquet(f"{out}/crossed")
    assert sorted((r.s, r.id, r.used) for r in got.collect()) == want


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 1, 2.5, 10, 9.99)] + [(None,), (float("nan"),)], "v double")
    got = C.histogram_data(df, "v", 5).orderBy("bin").collect()
    assert [r.n for r in got] == [3, 1, 0, 0, 2] and (got[0].low, got[4].high) == (0.0, 10.0)
    same = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert [r.n for r in C.histogram_data(same, "v", 2).orderBy("bin").collect()] == [4, 0]


def test_cumulative(events):
    got = C.cumulative_line(events, "ts", "hour", "tokens", ranges=1).collect()
    assert got[-1].running_total == sum(r.tokens for r in events.collect())


def test_band_join(spark):
    df = spark.createDataFrame([(float(v),) for v in range(-20, 40)], "v double")
    bands = spark.createDataFrame([("a", -5.0, 3.0), ("b", 0.0, 30.5), ("c", 2.0, 2.0)], "n string, lo double, hi double")
    got = sorted((r.n, r.v) for r in R.band_join(df, "v", bands, "lo", "hi", 4.0).collect())
    assert got == sorted((n, float(v)) for n, lo, hi in (("a", -5, 3), ("b", 0, 30.5)) for v in range(-20, 40) if lo <= v < hi)


def test_sql_entry(spark):
    data = spark.createDataFrame([(1, "data"), (2, "x")], "data_id int, note string")
    one = R.sql_query(spark, {"data": data}, "SELECT sum(data_id) FROM data WHERE note = 'data'")
    assert R.scalar_answer(one) == 1
    many = R.sql_query(spark, {"data": data}, "SELECT data_id FROM data")
    assert R.scalar_answer(many) is many


def test_top_k(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "k string, v int")
    got = R.top_k(df, ["k"], [F.desc("v")], 2).collect()
    assert sorted((r.k, r.v, r.place) for r in got) == [("a", 48, 2), ("a", 49, 1), ("b", 1, 1)]
