"""Joins and windows over time against plain versions, in one range and in several."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerloom.operators import sessions, temporal
from answerloom.streaming import keyed, rollups

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("ranges", [1, 6])
def test_as_of(spark, ranges):
    pick = random.Random(5)
    key = lambda: pick.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(key(), pick.choice([*range(60), None]), k) for k in range(300)] + [("alone", 5, 900)] * 2
    right = [(key(), pick.choice([*range(0, 60, 3), None]), pick.randrange(5), f"r{k}") for k in range(200)]
    a, b = spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, t int, n int, v string")
    want = Counter()
    for k, t, i in left:
        fits = [r[1:] for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        want[(k, t, i, *(max(fits) if fits else (None, None, None)))] += 1
    got = temporal.as_of_join(a, b, ["k"], "t", "t", ["n", "v"], ranges=ranges)
    assert got.columns == ["k", "t", "id", "last_t", "last_n", "last_v"]
    assert Counter(map(tuple, got.collect())) == want
    assert temporal.as_of_join(a.limit(0), b, ["k"], "t", "t").count() == 0
    assert {r.last_v for r in temporal.as_of_join(a, b.limit(0), ["k"], "t", "t").collect()} == {None}
    with pytest.raises(ValueError, match="last_t"):
        temporal.as_of_join(a.withColumn("last_t", F.lit(1)), b, ["k"], "t", "t")


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("width", [0.5, 3.0, 1000.0])
def test_intervals(spark, closed, width):
    pick = random.Random(8)
    nan = float("nan")

    def some(n):
        rows = []
        for k in range(n):
            low = pick.choice([float(pick.randrange(-40, 40)), pick.random() * 50])
            rows.append((pick.choice(["x", "x", "y", None]), k, low, low + pick.choice([0.0, 1.0, 2.5, 7.0, 60.0, 3000.0, -2.0])))
        return rows + [("x", n, None, 3.0), ("x", n + 1, 1.0, None), ("x", n + 2, nan, 4.0), ("x", n + 3, 0.0, nan)]

    left, right = some(60), some(50)
    a, b = spark.createDataFrame(left, "k string, i int, lo double, hi double"), spark.createDataFrame(right, "k string, j int, lo2 double, hi2 double")

    def meet(p, q):
        ends = (*p[2:], *q[2:])
        if None in ends or any(x != x for x in ends):
            return False
        ok = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
        return ok(p[2], p[3]) and ok(q[2], q[3]) and ok(max(p[2], q[2]), min(p[3], q[3]))

    for keys in ([], ["k"]):
        want = Counter((p[1], q[1]) for p in left for q in right if meet(p, q) and (not keys or p[0] is not None and p[0] == q[0]))
        got = temporal.interval_join(a if keys else a.drop("k"), b if keys else b.drop("k"), ("lo", "hi"), ("lo2", "hi2"), width, keys, closed)
        assert Counter((r.i, r.j) for r in got.collect()) == want
    assert temporal.interval_join(a.limit(0), b.drop("k"), ("lo", "hi"), ("lo2", "hi2"), width).count() == 0


@pytest.fixture(scope="module")
def visits(spark):
    pick = random.Random(2)
    rows, at = [], defaultdict(lambda: T0)
    for k in range(400):
        user = pick.choice(["hot", "hot", "hot", "b", None])
        at[user] += dt.timedelta(seconds=pick.choice([0, 1, 20, 60, 60, 61, 300]))
        rows.append((user, at[user], k, pick.randrange(50)))
    return spark.createDataFrame(rows, "u string, ts timestamp_ntz, id int, tokens int").persist()


def plain_sessions(df, gap):
    out, rows = [], defaultdict(list)
    for r in df.collect():
        rows[r.u].append(r)
    for user, mine in rows.items():
        mine.sort(key=lambda r: r.ts)
        runs = [[mine[0]]]
        for r in mine[1:]:
            if (r.ts - runs[-1][-1].ts).total_seconds() > gap:
                runs.append([])
            runs[-1].append(r)
        out += [(user, k + 1, run[0].ts, run[-1].ts, len(run), sum(r.tokens for r in run)) for k, run in enumerate(runs)]
    return out


def measures():
    return {"n": F.count(F.lit(1)), "total": F.sum("tokens")}


@pytest.mark.parametrize("ranges", [1, 5])
def test_gap_sessions(spark, visits, ranges):
    timeless = spark.createDataFrame([("hot", None, -1, 7)], visits.schema)
    got = temporal.gap_sessions(visits.unionByName(timeless), ["u"], "ts", 60, measures(), ["id"], ranges=ranges)
    assert Counter(map(tuple, got.collect())) == Counter(plain_sessions(visits, 60))


def arrive(spark, df, path, process, late=0):
    """The rows in four parts by time; every seventh comes a part late."""
    rows = df.orderBy("ts", "id").collect()
    for part in range(5):
        mine = [r for k, r in enumerate(rows) if k * 4 // len(rows) + (1 if late and k % 7 == 0 else 0) == part]
        spark.createDataFrame(mine, df.schema).coalesce(2).write.mode("append").parquet(path)
        process(rollups.event_stream(spark, path, df.schema))


def test_stream_sessions_equal_batch(spark, visits, tmp_path):
    """Sessions that the watermark has passed come out, each once, with late rows in their place."""
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    arrive(spark, visits, str(tmp_path / "in"), lambda s: keyed.run_keyed(keyed.stream_gap_sessions(s, ["u"], "ts", 60, "2 hours", measures()), out, mark), late=1)
    last = visits.agg(F.max("ts")).first()[0] - dt.timedelta(hours=2, seconds=60)
    want = [(r[0], *r[2:]) for r in plain_sessions(visits, 60) if r[3] < last]
    got = spark.read.parquet(out).select("u", F.col("session_start").cast("timestamp_ntz"), F.col("session_end").cast("timestamp_ntz"), "n", "total")
    assert len(want) > 3 and Counter(map(tuple, got.collect())) == Counter(want)


@pytest.mark.parametrize("length,slide", [(600, 200), (500, 300), (100, 100), (70, 30)])
def test_sliding(spark, visits, length, slide):
    want = Counter()
    for r in visits.collect():
        at = int((r.ts - dt.datetime(1970, 1, 1)).total_seconds())
        for start in range(at // slide * slide, at - length, -slide):
            want[(r.u, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=start), "n")] += 1
            want[(r.u, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=start), "total")] += r.tokens
    rows = temporal.sliding_windows(visits, ["u"], "ts", length, slide, {"n": F.lit(1), "total": F.col("tokens")})
    got = Counter()
    for r in rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).collect():
        got[(r.u, r.window_start, "n")] += r.n
        got[(r.u, r.window_start, "total")] += r.total
    assert got == want


def test_sliding_copies_panes_not_rows(visits):
    """The rows are added up before they are copied into windows."""
    plan = temporal.sliding_windows(visits, ["u"], "ts", 3600, 60, {"n": F.lit(1)})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate") if "Expand" in plan else plan.count("Aggregate") == 2


@pytest.mark.parametrize("late", [0, 1])
def test_keyed_budget_equals_batch(spark, visits, tmp_path, late):
    """The same first events over the line as in batch, also where rows come late and one session has most of them."""
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda s: keyed.run_keyed(keyed.stream_budget(s, "u", "ts", "tokens", "1 minute", "2 hours", budget=1000), out, mark)
    arrive(spark, visits, str(tmp_path / "in"), run, late)
    crossings = spark.read.parquet(out)
    got = keyed.crossing_events(visits, crossings, "u", "ts", ["ts", "id"], "tokens", budget=1000, ranges=3)
    batch = sessions.token_budget(visits, "u", ["ts", "id"], "tokens", budget=1000).where("switched")
    first = batch.groupBy("u").agg(F.min_by(F.struct("ts", "id", "used"), F.struct("ts", "id")).alias("f")).select("u", "f.*")
    last = visits.agg(F.max("ts")).first()[0] - dt.timedelta(hours=2, minutes=1)
    want = [tuple(r) for r in first.collect() if r.ts < last]
    assert want and Counter(map(tuple, got.collect())) == Counter(want)


def test_keyed_budget_state(spark, visits, tmp_path):
    """State is one row per session, however many batches and buckets there were; the session's setting is as it was."""
    out, mark, seen = str(tmp_path / "out"), str(tmp_path / "mark"), []
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    run = lambda s: keyed.run_keyed(keyed.stream_budget(s, "u", "ts", "tokens", "1 minute", "1 minute", budget=1000), out, mark)
    arrive(spark, visits, str(tmp_path / "in"), lambda s: seen.append(run(s)))
    assert spark.conf.get(setting, None) == before
    keyed_rows = [op["numRowsTotal"] for p in seen if p for op in p["stateOperators"] if "transformWithState" in op["operatorName"]]
    assert keyed_rows and max(keyed_rows) <= 3


class _Held(dict):
    getValue, updateValue = dict.get, dict.__setitem__  # noqa: N815


def test_keyed_budget_takes_many_sessions_at_a_call():
    budget, hour = keyed._Budget(100.0, "bigint"), lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    budget.state = _Held({(2**60 + 1,): (90, False), (5,): (500, True)})

    def call(part, *rows):
        frame = pd.DataFrame([(s, hour(h), hour(h + 1), n) for s, h, n in rows], columns=["session", "bucket_start", "bucket_end", "more"])
        return [tuple(r) for got in budget.handleInputRows((part,), iter([frame.iloc[:2], frame.iloc[2:]]), None) for r in got.itertuples(index=False)]

    got = call(3, (7, 2, 60), (2**60 + 1, 1, 10), (7, 0, 30), (5, 0, 9), (7, 1, 20), (8, 0, 99), (7, 3, 70))
    assert sorted(got) == [(7, hour(2), hour(3), 50, 110), (2**60 + 1, hour(1), hour(2), 90, 100)]
    assert budget.state == {(2**60 + 1,): (100, True), (5,): (500, True), (7,): (180, True), (8,): (99, False)}
    assert call(3, (7, 4, 1000)) == [] and call(3, (8, 5, 1)) == [(8, hour(5), hour(6), 99, 100)]
    assert call(-1, (None, 0, 60)) == [] and call(-1, (None, 1, 60)) == [(None, hour(1), hour(2), 60, 120)]


def test_keyed_budget_of_null_and_wide_sessions(spark, visits, tmp_path):
    """A null session is a session, and the others stay whole numbers beside it."""
    out, mark, wide = str(tmp_path / "out"), str(tmp_path / "mark"), 2**60 + 1
    wider = visits.withColumn("u", F.when(F.col("u") == "hot", F.lit(None)).otherwise(wide + F.pmod(F.xxhash64("u"), F.lit(1000))).cast("bigint"))
    arrive(spark, wider, str(tmp_path / "in"), lambda s: keyed.run_keyed(keyed.stream_budget(s, "u", "ts", "tokens", "1 minute", "2 hours", budget=1000), out, mark))
    batch = sessions.token_budget(wider, "u", ["ts", "id"], "tokens", budget=1000).where("switched")
    first = batch.groupBy("u").agg(F.min("ts").alias("ts")).collect()
    last = visits.agg(F.max("ts")).first()[0] - dt.timedelta(hours=2, minutes=1)
    want = {r.u: r.ts.replace(second=0, microsecond=0) for r in first if r.ts < last}
    got = spark.read.parquet(out).select("session", F.col("bucket_start").cast("timestamp_ntz")).collect()
    assert None in want and {r[0]: r[1] for r in got} == want and len(got) == len(want)


def test_slide_longer_than_window_raises(visits):
    with pytest.raises(ValueError, match="slide"):
        temporal.sliding_windows(visits, ["u"], "ts", 60, 90, {"n": F.lit(1)})


@pytest.mark.parametrize("closed, ranges", [(False, None), (True, 5)])
def test_overlap_totals_make_no_pairs(spark, closed, ranges):
    rng = random.Random(4)
    some = lambda n, most: [(i, float(a := rng.randrange(-40, 40)), a + rng.choice([0.0, 1.0, -1.0, rng.randrange(most) * 0.5])) for i in range(n)]
    odd = [(900, None, 3.0), (901, float("nan"), 3.0), (902, -100.0, float("inf")), (903, 0.0, 0.0), (904, -0.0, 4.0)]
    left, right = some(60, 90) + odd, some(300, 12) + odd
    a = spark.createDataFrame(left, "l long, low double, high double")
    b = spark.createDataFrame(right, "r long, from double, to double")
    measures = {"n": ("count", F.lit(1)), "least": ("min", F.col("r")), "most": ("max", F.col("r")), "total": ("sum", F.col("r"))}
    found = temporal.overlap_totals(a, b, ("low", "high"), ("from", "to"), measures, closed=closed, ranges=ranges)
    got = {x.l: (x.n, x.least, x.most, x.total) for x in found.collect()}
    fits = lambda x, y: x is not None and (x <= y if closed else x < y)
    want = {}
    for i, low, high in left:
        met = [r for r, f, t in right if fits(low, high) and fits(f, t) and fits(f, high) and fits(low, t)]
        if met:
            want[i] = (len(met), min(met), max(met), sum(met))
    assert got == want


def test_overlap_totals_do_not_grow_with_the_pairs(spark):
    # 9 * 10**10 pairs; joined, they would not end.
    wide = spark.range(300_000).selectExpr("id AS l", "CAST(id % 1000 AS double) AS low", "CAST(id % 1000 + 1000000 AS double) AS high")
    inner = spark.range(300_000).selectExpr("id AS r", "CAST(id + 2000 AS double) AS from", "CAST(id + 2001 AS double) AS to")
    found = temporal.overlap_totals(wide, inner, ("low", "high"), ("from", "to"), {"n": ("count", F.lit(1)), "least": ("min", F.col("r"))})
    assert found.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.max("least")).collect()[0][:] == (300_000, 300_000, 300_000, 0)


def test_events_of_a_long_time_are_not_later_than_the_delay(spark, tmp_path, monkeypatch):
    from catalog import q_temporal

    events = spark.range(2_000).selectExpr("id AS event_id", "CAST(TIMESTAMP_SECONDS(1700000000 + id * 7200) AS timestamp_ntz) AS ts")  # 166 days
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(q_temporal.R, "event_stream", lambda spark, path, schema: spark.read.parquet(path))
    runs = []
    q_temporal._arrive_late(spark, str(tmp_path), 3, lambda df: runs.append({r.event_id: r.ts for r in df.collect()}))
    assert len(runs) == 4 and len(runs[-1]) == 2_000
    delays = []
    for before, after in zip(runs, runs[1:]):
        upto = max(before.values())
        delays += [upto - ts for i, ts in after.items() if i not in before and ts < upto]
    assert delays and max(delays) <= dt.timedelta(days=10)
