"""Summaries over graded answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grading_summary(
    graded: DataFrame, keys: Sequence[str], correct: str, answer: str, order: Sequence[str]
) -> DataFrame:
    """Attempts, correct ones, last answer and accuracy per user or chain."""
    right = F.col(correct)
    return graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(right).alias("correct"),
        F.max_by(F.col(answer), F.struct(*order)).alias("last_answer"),
        F.avg(right.cast("double")).alias("accuracy"),
    )
