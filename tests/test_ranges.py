"""Range-split results must equal the plain window, also when one key holds most rows."""

import pytest
from pyspark.sql import functions as F

from answerloom.plans import ranges as R


@pytest.fixture(scope="module")
def rows(spark):
    # Two thirds of the rows have key 0, a third of the values are equal, some keys are null.
    return (
        spark.range(3000)
        .select(
            F.when(F.col("id") % 3 < 2, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 5).alias("k"),
            F.col("id"),
            F.when(F.col("id") % 3 == 1, 500).otherwise((F.col("id") * 37) % 1009).alias("v"),
            (F.col("id") % 11 - 3).cast("double").alias("x"),
        )
        .cache()
    )


def as_set(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("ranges", [2, 7, 40])
def test_running_equals_window(rows, ranges):
    measures = {
        "s": ("sum", F.col("x")),
        "n": ("count", F.when(F.col("x") > 0, 1)),
        "lo": ("min", F.col("x")),
        "hi": ("max", F.when(F.col("x") < 0, F.col("x"))),
    }
    plain = R.running(rows, ["k"], ["v", "id"], measures, 1)
    split = R.running(rows, ["k"], ["v", "id"], measures, ranges)
    assert as_set(plain) == as_set(split.select(*plain.columns))


def test_running_without_key(rows):
    m = {"s": ("sum", F.col("x"))}
    assert as_set(R.running(rows, [], ["v", "id"], m, 1)) == as_set(R.running(rows, [], ["v", "id"], m, 9))


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour(rows, ahead):
    got = R.neighbour(rows, ["k"], ["v", "id"], {"other": "x", "who": "id"}, ahead, 23)
    want = R.neighbour(rows, ["k"], ["v", "id"], {"other": "x", "who": "id"}, ahead, 1)
    assert as_set(got.select(*want.columns)) == as_set(want)


@pytest.mark.parametrize("tiles", [3, 1000])
def test_ranked(rows, tiles):
    got = R.ranked(rows, ["k"], "v", ["id"], tiles, 13)
    want = R.ranked(rows, ["k"], "v", ["id"], tiles, 1)
    assert as_set(got.select(*want.columns)) == as_set(want)


def test_quantiles(rows):
    q = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = R.quantiles(rows, ["k"], "v", q, 11).orderBy("k").collect()
    want = rows.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in q.items()]).orderBy("k").collect()
    assert [[round(float(x or 0), 9) for x in r] for r in got] == [[round(float(x or 0), 9) for x in r] for r in want]


def test_ranges_are_even_and_in_order(rows):
    sizes = R.in_ranges(rows, ["v", "id"], 10, "r").groupBy("r").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("r").collect()
    assert len(sizes) == 10 and max(r.n for r in sizes) < 3000 / 10 * 2
    assert all(a.hi <= b.lo for a, b in zip(sizes, sizes[1:]))


def test_many_ranges_plan_like_few(rows):
    size = lambda n: len(R.running(rows, ["k"], ["v", "id"], {"s": ("sum", F.col("x"))}, n)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(4096) - size(8)) < 200


def test_instants_across_a_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        hour = 1730606400  # 2024-11-03 04:00 UTC; the clock goes back two hours later
        df = spark.range(60).select(F.timestamp_seconds(F.lit(hour) + F.col("id") * 300).alias("t"), F.col("id"))
        got = R.running(df, [], ["t"], {"s": ("sum", F.col("id"))}, 12).collect()
        assert all(r.s == r.id * (r.id + 1) // 2 for r in got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_time_order(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    m = {"s": ("sum", F.col("event_id"))}
    got = R.running(events, ["user_id"], ["ts", "event_id"], m, 6)
    assert as_set(got) == as_set(R.running(events, ["user_id"], ["ts", "event_id"], m, 1).select(*got.columns))


def test_last_rows(spark):
    rows = spark.range(5000).select((F.col("id") * 7 % 5003).alias("v"))
    want = [r.v for r in rows.orderBy(F.desc("v")).limit(40).collect()][::-1]
    assert [r.v for r in R.last_rows(rows, ["v"], 40).collect()] == want
    assert R.last_rows(rows, ["v"], 4990).count() == 4990


def test_spread_leaves_large_input_alone(spark, sf, monkeypatch):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert R.spread(events).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(R, "RANGE_BYTES", 10)
    assert R.spread(events).rdd.getNumPartitions() == events.rdd.getNumPartitions()


def test_ranges_are_counted_by_whole_rows(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id % 3 AS k", "id AS at", "sha2(CAST(id AS string), 512) AS wide").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    asked, in_ranges = [], R.in_ranges
    monkeypatch.setattr(R, "RANGE_BYTES", R.plan_bytes(df) // 3)
    monkeypatch.setattr(R, "in_ranges", lambda df, order, n, *more: asked.append(n) or in_ranges(df, order, n, *more))
    assert R.plan_bytes(df.select("at")) > 0
    got = R.running(df.withColumn("n", F.lit(1)), ["k"], ["at"], {"upto": ("sum", F.col("n"))}).where("upto != floor(at / 3) + 1").count()
    assert got == 0 and asked and asked[0] >= 3
