"""Session events as a stream: rollups per window, and token budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom import fixed_values as V
from answerloom.plans.ranges import running
from answerloom.plans.staging import cut_lineage


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_audit_rollup(
    events: DataFrame, session: str, time: str, step: str, window: str, delay: str, error_step: str = "error"
) -> DataFrame:
    """Steps, errors, first and last time per session and window; rows later than the delay are dropped.

    The same expression works on a batch and on a stream. Steps are counted
    before the shuffle, so a busy session costs one row per task and window.
    """
    timed = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", delay)
    return (
        timed.groupBy(F.col(session), F.window("__at", window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("steps"),
            F.count_if(F.col(step) == error_step).alias("errors"),
            F.min("__at").alias("first_at"),
            F.max("__at").alias("last_at"),
        )
        .select(
            session,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "steps",
            "errors",
            "first_at",
            "last_at",
        )
    )


def run_append(result: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there; windows the watermark has passed go to parquet files, each once."""
    query = (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_update(result: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there; the rows that a batch changed go to a folder of its own.

    A batch that is run again writes the same folder again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        result.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_rows(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The result after the last batch: of each key the row of the last batch that changed it."""
    every = spark.read.parquet(out)
    kept = [c for c in every.columns if c not in (*keys, "batch")]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*kept), "batch").alias("__last"))
    return last.select(*keys, "__last.*")


def run_token_budget(
    events: DataFrame,
    session: str,
    order: Sequence[str],
    tokens: str,
    out: str,
    checkpoint: str,
    budget: float = V.TOKEN_BUDGET,
    threshold: float = V.BUDGET_THRESHOLD,
    ranges: int | None = None,
) -> None:
    """Running use per session over the stream; each session is reported once, when it reaches the threshold.

    A batch writes the use so far of the sessions it has events of, and no others, to a folder of its own; what earlier
    batches wrote for these sessions is read back, the latest counts. A batch run again reads
    the same folders and writes the same. Only sessions that cross in the batch are looked at event by event.
    """
    spark = events.sparkSession
    line = float(budget) * threshold if budget > 0 else float("-inf")
    kind = events.schema[session].dataType.simpleString()
    empty = f"{session} {kind}, used bigint, crossed boolean"

    def step(batch: DataFrame, batch_id: int) -> None:
        slim = cut_lineage(batch.select(session, *order, F.col(tokens).alias("tokens")))
        if batch_id > 0:
            earlier = spark.read.schema(f"{empty}, batch bigint").parquet(f"{out}/state").where(F.col("batch") < batch_id)
            earlier = earlier.join(slim.select(session).distinct(), session, "left_semi")
            latest = earlier.groupBy(session).agg(F.max_by(F.struct("used", "crossed"), "batch").alias("__latest"))
            before = latest.select(session, "__latest.*")
        else:
            before = spark.createDataFrame([], empty)
        sums = slim.groupBy(session).agg(F.sum("tokens").alias("more"))
        merged = sums.join(before, session, "left").select(
            session,
            F.coalesce("used", F.lit(0)).alias("before"),
            (F.coalesce("used", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("used"),
            F.coalesce("crossed", F.lit(False)).alias("was"),
        )
        now = F.col("was") | (F.col("used") >= line)
        merged.select(session, "used", now.alias("crossed")).write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")
        state = spark.read.schema(empty).parquet(f"{out}/state/batch={batch_id}")
        old = before.select(session, F.col("used").alias("__before"), F.col("crossed").alias("__was"))
        crossing = (
            state.where("crossed").select(session).join(old, session, "left").where("NOT coalesce(__was, false)")
        )
        candidates = slim.join(crossing.select(session, F.coalesce("__before", F.lit(0)).alias("__start")), session)
        upto = running(candidates, [session], order, {"__here": ("sum", F.col("tokens"))}, ranges)
        upto = upto.withColumn("used", F.col("__start") + F.col("__here")).where(F.col("used") >= line)
        first = upto.groupBy(session).agg(F.min_by(F.struct(*order, "used"), F.struct(*order)).alias("f"))
        first.select(session, "f.*").write.mode("overwrite").parquet(f"{out}/crossed/batch={batch_id}")

    query = (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
