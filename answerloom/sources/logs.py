"""Log files: lines in file order, parsed, and the last ones of a level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.plans.ranges import last_rows


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, nr, line)``; file, block and nr put the lines in file order."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nr"),
        F.col("value").alias("line"),
    )


def parse_log_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds ``at``, ``name``, ``level`` and ``message``; null where a line is not of the form."""
    line = F.col(column)
    fits = line.rlike(V.LOG_LINE)

    def part(group: int):
        return F.when(fits, F.regexp_extract(line, V.LOG_LINE, group))

    return lines.select(
        "*",
        part(1).try_cast("timestamp_ntz").alias("at"),
        part(2).alias("name"),
        part(3).alias("level"),
        part(4).alias("message"),
    )


def log_tail(
    parsed: DataFrame, order: Sequence[str], level: str = "all", n: int = V.LOG_LINES_DEFAULT
) -> DataFrame:
    """The last n lines of a level (or of all), in file order."""
    if not 1 <= n <= V.LOG_LINES_MAX:
        raise ValueError(f"n is between 1 and {V.LOG_LINES_MAX}")
    kept = parsed if level.lower() == "all" else parsed.where(F.col("level") == level.upper())
    return last_rows(kept, order, n)
