"""Session event queries, batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.operators import sessions as S
from answerloom.plans.ranges import in_ranges
from answerloom.plans.staging import stage_path
from answerloom.streaming import rollups as R
from catalog import query, table
from catalog.derived import TOKENS, derived


@query(
    "T1_audit_rollup",
    """
SELECT user_id, count(*) AS steps, min(ts) AS first_at, max(ts) AS last_at,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 6) AS elapsed,
  count(*) FILTER (WHERE event_type = 'error') AS errors
FROM events GROUP BY user_id
""",
)
def t1(spark, sf_dir):
    rollup = S.audit_rollup(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")
    return rollup.withColumn("elapsed", F.round("elapsed", 6))


@query(
    "T1_audit_steps",
    """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_no, event_type AS step FROM events
""",
)
def t1_steps(spark, sf_dir):
    return S.audit_steps(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(
    "T2_deadline_status",
    """
SELECT event_id, round(safe_seconds, 6) AS safe_seconds, safe_seconds <= 5 AS critical FROM (
  SELECT event_id, greatest(0.0, 180.0 * 1000 - (epoch_us(ts) - started) / 1000000.0 - 10.0) AS safe_seconds FROM (
    SELECT event_id, ts, coalesce(
      max(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) OVER w, min(epoch_us(ts)) OVER w) AS started
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
""",
)
def t2(spark, sf_dir):
    # Events of a user are hours apart here, so the limit is set a thousand times wider.
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    status = S.deadline_status(
        events, "user_id", "ts", ["ts", "event_id"], F.col("event_type") == "view", limit=180_000
    )
    return status.select("event_id", F.round("safe_seconds", 6).alias("safe_seconds"), "critical")


@query(
    "T3_token_budget",
    f"""
SELECT event_id, used, round(used / 200000.0, 6) AS share, used / 200000.0 >= 0.75 AS switched FROM (
  SELECT event_id, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY ts, event_id) AS BIGINT) AS used FROM ({TOKENS}))
""",
)
def t3(spark, sf_dir):
    usage = S.token_budget(derived(spark, sf_dir, TOKENS), "session", ["ts", "event_id"], "tokens", budget=200_000)
    return usage.select("event_id", "used", F.round("share", 6).alias("share"), "switched")


def _arrive(spark, sf_dir, parts: int, process) -> None:
    """The events arrive in parts, in time order; the stream is started anew after each part."""
    path = stage_path(spark, "events")
    events = table(spark, sf_dir, "events")
    ranged = in_ranges(events, ["ts", "event_id"], parts, "part")
    for number in range(parts):
        ranged.where(F.col("part") == number).drop("part").write.mode("append").parquet(path)
        process(R.event_stream(spark, path, events.schema))


@query(
    "T4_stream_audit_rollup",
    """
SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS steps,
  count(*) FILTER (WHERE event_type = 'error') AS errors, min(ts) AS first_at, max(ts) AS last_at
FROM events GROUP BY ALL
""",
)
def t4(spark, sf_dir):
    out, checkpoint = stage_path(spark, "rollup"), stage_path(spark, "rollup-checkpoint")

    def process(stream):
        R.run_update(R.stream_audit_rollup(stream, "user_id", "ts", "event_type", "1 day", "1 day"), out, checkpoint)

    _arrive(spark, sf_dir, 2, process)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "first_at", "last_at")}
    return R.latest_rows(spark, out, ["user_id", "window_start", "window_end"]).withColumns(times).drop("window_end")


@query(
    "T4_stream_closed_windows",
    """
SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS steps,
  count(*) FILTER (WHERE event_type = 'error') AS errors, min(ts) AS first_at, max(ts) AS last_at
FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL
""",
)
def t4_closed(spark, sf_dir):
    out, checkpoint = stage_path(spark, "closed"), stage_path(spark, "closed-checkpoint")

    def process(stream):
        R.run_append(R.stream_audit_rollup(stream, "user_id", "ts", "event_type", "1 day", "1 day"), out, checkpoint)

    _arrive(spark, sf_dir, 2, process)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "first_at", "last_at")}
    return spark.read.parquet(out).withColumns(times).drop("window_end")


@query(
    "T5_stream_token_budget",
    f"""
SELECT session, event_id, ts, used FROM (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS r FROM (
    SELECT *, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY ts, event_id) AS BIGINT) AS used FROM ({TOKENS}))
  WHERE used >= 150000) WHERE r = 1
""",
)
def t5(spark, sf_dir):
    out, checkpoint = stage_path(spark, "budget"), stage_path(spark, "budget-checkpoint")

    def process(stream):
        tokens = F.floor(F.col("value") * 100).cast("bigint").alias("tokens")
        uses = stream.select(F.col("user_id").alias("session"), "ts", "event_id", tokens)
        R.run_token_budget(uses, "session", ["ts", "event_id"], "tokens", out, checkpoint, budget=200_000)

    _arrive(spark, sf_dir, 3, process)
    return spark.read.parquet(f"{out}/crossed").select("session", "event_id", "ts", "used")
