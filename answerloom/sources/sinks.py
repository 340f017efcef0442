"""Tables as JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.plans.ranges import running


def _record(df: DataFrame):
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def to_json_records(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """One JSON object per row with its number in the stated order; nulls are written.

    ``order`` must be a total order.
    """
    records = df.select(*order, _record(df).alias("record"))
    numbered = running(records, [], order, {"record_no": ("count", F.lit(1))}, ranges)
    return numbered.select("record_no", "record")


def json_answer(df: DataFrame, order: Sequence[str], limit: int = V.MAX_ANSWER_BYTES) -> DataFrame:
    """The whole table as one JSON array, for tables small enough to be an answer.

    The size is added up first; a table over the limit raises and nothing is gathered.
    """
    records = df.select(F.struct(*order).alias("o"), _record(df).alias("r"))
    size = records.agg(F.coalesce(F.sum(F.octet_length("r") + 1), F.lit(0)) + 1).first()[0]
    if size > limit:
        raise ValueError(f"{V.TOO_LARGE_REASON}: {size} bytes")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("o", "r"))), lambda x: x["r"])
    return records.agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("answer"))


def write_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines files that follow the order from file to file and line to line."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("ignoreNullFields", "false").json(path)
