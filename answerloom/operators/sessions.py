"""Session events in batch: audit, deadlines and token budgets.

A session may hold any share of the events, so nothing here gathers a session
in one place: step lists are rows with a step number, running values are split
in ranges of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.plans.ranges import running


def seconds(time: str) -> Column:
    """Seconds since the epoch, with microseconds."""
    return F.unix_micros(F.col(time).cast("timestamp")) / 1e6


def audit_rollup(events: DataFrame, session: str, time: str, step: str, error_step: str = "error") -> DataFrame:
    """Steps, first and last time, elapsed seconds and errors per session."""
    return events.groupBy(session).agg(
        F.count(F.lit(1)).alias("steps"),
        F.min(time).alias("first_at"),
        F.max(time).alias("last_at"),
        (F.max(seconds(time)) - F.min(seconds(time))).alias("elapsed"),
        F.count_if(F.col(step) == error_step).alias("errors"),
    )


def audit_steps(
    events: DataFrame, session: str, order: Sequence[str], step: str, ranges: int | None = None
) -> DataFrame:
    """The ordered step list of every session, as rows ``(session, step_no, step)``."""
    slim = events.select(session, *order, step)
    numbered = running(slim, [session], order, {"step_no": ("count", F.lit(1))}, ranges)
    return numbered.select(session, "step_no", F.col(step).alias("step"))


def deadline_status(
    events: DataFrame,
    session: str,
    time: str,
    order: Sequence[str],
    restarts: Column,
    limit: float = V.TIME_LIMIT_SECONDS,
    buffer: float = V.SAFETY_BUFFER_SECONDS,
    ranges: int | None = None,
) -> DataFrame:
    """Safe time left at every event, and whether it is critical.

    The clock starts with the session and again at every restarting event.
    """
    timed = events.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")))
    started = running(
        timed,
        [session],
        order,
        {"__restart": ("max", F.when(restarts, F.col("__at"))), "__begin": ("min", F.col("__at"))},
        ranges,
    )
    elapsed = (F.col("__at") - F.greatest("__restart", "__begin")) / 1e6
    left = F.greatest(F.lit(0.0), F.lit(float(limit)) - elapsed - F.lit(float(buffer)))
    return (
        started.withColumn("safe_seconds", left)
        .withColumn("critical", F.col("safe_seconds") <= V.CRITICAL_SECONDS)
        .drop("__at", "__restart", "__begin")
    )


def token_budget(
    events: DataFrame,
    session: str,
    order: Sequence[str],
    tokens: str,
    budget: float = V.TOKEN_BUDGET,
    threshold: float = V.BUDGET_THRESHOLD,
    ranges: int | None = None,
) -> DataFrame:
    """Running use and share of the budget; ``switched`` from the first event at the threshold.

    A budget of zero or less counts as used up.
    """
    used = running(events, [session], order, {"used": ("sum", F.col(tokens))}, ranges)
    share = F.col("used") / F.lit(float(budget)) if budget > 0 else F.lit(1.0)
    return used.withColumn("share", share).withColumn("switched", F.col("share") >= threshold)
