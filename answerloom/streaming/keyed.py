"""Streams whose state is kept per key in Spark's own state store (RocksDB)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from answerloom import fixed_values as V
from answerloom.plans.ranges import running

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back."""
    own = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, own)


#: Sessions are dealt to so many keys of the state store, each with a map of its sessions: a call costs the same for one session as
#: for hundreds. It decides where state lies, so a stream cannot go on under another number.
SESSION_PARTS = 1024
_NULL_PART = -1


class _Budget(StatefulProcessor):
    """Running use of each session of a part; tells the bucket in which one reaches the line."""

    def __init__(self, line: float, kind: str) -> None:
        self.line, self.kind = line, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("use", f"session {self.kind}", "used bigint, crossed boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import numpy as np
        import pandas as pd

        buckets = pd.concat(list(rows), ignore_index=True)  # sums of buckets that closed since the last batch
        codes, names = pd.factorize(buckets["session"], use_na_sentinel=False)
        order = np.lexsort((buckets["bucket_start"].to_numpy(), codes))
        buckets, codes = buckets.iloc[order], codes[order]
        ends = np.append(np.flatnonzero(np.diff(codes)), len(codes) - 1)
        starts = np.append(0, ends[:-1] + 1)
        names = [None] if key[0] == _NULL_PART else [n.to_pydatetime() if isinstance(n, pd.Timestamp) else n for n in pd.Index(names).astype(object)]
        held = [self.state.getValue((n,)) for n in names]
        used = np.array([h[0] if h else 0 for h in held], dtype="int64")
        crossed = np.array([bool(h and h[1]) for h in held])
        more = buckets["more"].to_numpy(dtype="int64")
        total = np.cumsum(more)
        upto = total + (used - (total - more)[starts])[codes]
        over = np.flatnonzero((upto >= self.line) & ~crossed[codes])
        reached, first = np.unique(codes[over], return_index=True)
        now = crossed.copy()
        now[reached] = True
        for c in np.flatnonzero(~crossed):  # what a session uses after it has crossed changes nothing
            self.state.updateValue((names[c],), (int(upto[ends[c]]), bool(now[c])))
        if len(reached):
            at = over[first]
            places = buckets.iloc[at]
            yield pd.DataFrame(
                {
                    "session": [names[c] for c in reached],
                    "bucket_start": places["bucket_start"].to_numpy(),
                    "bucket_end": places["bucket_end"].to_numpy(),
                    "before": upto[at] - more[at],
                    "used": upto[at],
                }
            )

    def close(self) -> None:
        pass


def stream_budget(
    events: DataFrame, session: str, time: str, tokens: str, bucket: str, delay: str, budget: float = V.TOKEN_BUDGET, threshold: float = V.BUDGET_THRESHOLD
) -> DataFrame:
    """A stream of (session, bucket_start, bucket_end, before, used): once per session, the bucket of time in which its use reaches the threshold.

    Use is added up in the order of event time, not of arrival: rows up to ``delay`` late count where they belong, later ones are dropped.
    Tokens are summed per (session, bucket) before the shuffle, and a closed bucket is one row of its session, so a busy session
    is no busier than another. The running total and whether the line is passed are a session's only state, read and written only where
    the session has closed buckets: a batch does the same work whatever came before it. ``SESSION_PARTS`` keys hold the sessions. ``crossing_events`` finds the very event. Null tokens are 0; a null session is a session.
    """
    line = float(budget) * threshold if budget > 0 else float("-inf")
    kind = events.schema[session].dataType.simpleString()
    timed = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", delay)
    closed = timed.groupBy(F.col(session).alias("session"), F.window("__at", bucket).alias("w")).agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("more"))
    closed = closed.select("session", F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"), "more")
    out = f"session {kind}, bucket_start timestamp, bucket_end timestamp, before bigint, used bigint"
    # Null has a part of its own and, among whole numbers, a number in its place: beside a null pandas would make them floats.
    part = F.when(F.col("session").isNull(), _NULL_PART).otherwise(F.pmod(F.xxhash64("session"), F.lit(SESSION_PARTS))).cast("int")
    closed = closed.withColumn("part", part)
    if isinstance(events.schema[session].dataType, T.IntegralType):
        closed = closed.withColumn("session", F.coalesce("session", F.lit(0).cast(kind)))
    return closed.groupBy("part").transformWithStateInPandas(_Budget(line, kind), out, "Append", "None")


def crossing_events(
    events: DataFrame, crossings: DataFrame, session: str, time: str, order: Sequence[str], tokens: str, budget: float = V.TOKEN_BUDGET, threshold: float = V.BUDGET_THRESHOLD,
    ranges: int | None = None,
) -> DataFrame:
    """The event of each crossing bucket at which the threshold is reached: session, order columns and ``used`` with it.

    Only events of crossing buckets are read further; ``order``, a total order within a session, begins with the time.
    """
    line = float(budget) * threshold if budget > 0 else float("-inf")
    marks = crossings.select(F.col("session").alias("__session"), "bucket_start", "bucket_end", "before")
    at = F.col(time).cast("timestamp")
    inside = F.col(session).eqNullSafe(F.col("__session")) & (at >= F.col("bucket_start")) & (at < F.col("bucket_end"))
    met = events.select(session, *order, tokens).join(marks, inside).select(session, *order, F.col(tokens).alias("__tokens"), "before")
    upto = running(met, [session], order, {"__here": ("sum", F.col("__tokens"))}, ranges).withColumn("used", F.col("before") + F.coalesce("__here", F.lit(0)))
    first = upto.where(F.col("used") >= line).groupBy(session).agg(F.min_by(F.struct(*order, "used"), F.struct(*order)).alias("f"))
    return first.select(session, "f.*")


def stream_gap_sessions(events: DataFrame, keys: Sequence[str], time: str, gap_seconds: float, delay: str, measures: Mapping[str, Column]) -> DataFrame:
    """``gap_sessions`` as a stream in append mode: a session comes out once, when the watermark has passed its end and the gap.

    Columns are the same but for session_no. Rows later than the delay are dropped. Spark keeps one session window per open session; with
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` a task's rows of a session are merged before the shuffle.
    """
    timed = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", delay)
    gap = f"{int(gap_seconds * 1_000_000)} microseconds"
    made = timed.groupBy(*keys, F.session_window("__at", gap).alias("__w")).agg(
        F.min("__at").alias("session_start"), F.max("__at").alias("session_end"), *[m.alias(n) for n, m in measures.items()]
    )
    return made.select(*keys, "session_start", "session_end", *measures)


def run_keyed(result: DataFrame, out: str, checkpoint: str) -> dict:
    """Process what is there, with state in RocksDB; rows go to parquet files, each once. Returns the progress of the last batch."""
    with rocksdb(result.sparkSession):
        writer = result.writeStream.outputMode("append").format("parquet").option("path", out)
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.lastProgress
