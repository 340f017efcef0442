"""Exchanges of packed rows: few rows that carry arrays, instead of a row per word or phrase.

A block of texts sends one row to each bucket of keys, holding sorted, compressed arrays; a
bucket sends one row back to each block. Blocks are numbered by partition and place, so a
plain scan read twice gives the same blocks (``pin_splits``); ``fingerprint`` lets the receiver check that.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm.texts import blocks, flat, release


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions: the user's measure of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def press(values: np.ndarray | bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes())


def unpress(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def press_steps(values: np.ndarray) -> bytes:
    """Long integers by their differences; small steps cost a byte or less."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    planes = steps.astype("<i8").view(np.uint8).reshape(-1, 8).T  # like bytes together
    return press(np.ascontiguousarray(planes))


def unpress_steps(data: bytes) -> np.ndarray:
    planes = unpress(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").reshape(-1))


def press_planes(values: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte of their places: high bytes that are all zero cost nothing."""
    return press(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T))


def unpress_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpress(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def fingerprint(data: np.ndarray, offsets: np.ndarray) -> int:
    return (len(offsets) << 32) ^ zlib.crc32(np.ascontiguousarray(data))


def pin_splits(spark: SparkSession) -> None:
    """Fixes into how many splits a scan is cut at least, for operators that read a table twice.

    Spark plans the splits of every reading from the cores it has at that moment, unless spark.sql.files.minPartitionNum
    says how many. A lost or late executor between two readings would then change the blocks. Set
    to what Spark would take now, and only where the session does not set it.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)


DIFFER = "blocks differ between two readings of the same rows; write the input to a table first"


def signed(data: np.ndarray, offsets: np.ndarray, answer: bytes) -> bytes:
    """An answer that begins with the fingerprint of its block's first reading, without it; raises if this is another block."""
    if np.frombuffer(answer, np.int64, 1)[0] != fingerprint(data, offsets):
        raise ValueError(DIFFER)
    return answer[8:]


PLACE_BITS, ROW_BITS = 21, 21  # of a block in its partition, and of a row in its block; 21 more are left for the partition


def block_number(part: int, place: int) -> int:
    """The number of a block; with a row's place below it, still a long."""
    if part >> (63 - PLACE_BITS - ROW_BITS) or place >> PLACE_BITS:
        raise ValueError(f"block {place} of partition {part} has no number of 63 bits with its rows")
    return (part << PLACE_BITS) + place


def numbered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
    """(number, rows, bytes, offsets) of every block of this task's partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for place, table in enumerate(blocks(batches, text, most)):
        yield (block_number(part, place), table, *flat(table[text]))


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def table_rows(df: DataFrame, text: str, most: int, answer: str = "answer") -> DataFrame:
    """One row per block: its number, its rows as a compressed Arrow stream, and a null answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table, _, _ in numbered(batches, text, most):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([to_ipc(table)], pa.binary()), pa.array([None], pa.binary())], names=["block", "rows", answer])

    return df.mapInArrow(run, f"block long, rows binary, {answer} binary")


def back_to_blocks(df: DataFrame, answers: DataFrame, finish: Callable[[int, pa.Table, list[bytes]], pa.Table], schema, text: str, most: int) -> DataFrame:
    """Brings the ``answers`` (block, answer) to the rows of their blocks: one exchange of compressed blocks."""
    sides = table_rows(df, text, most).unionByName(answers.select("block", F.lit(None).cast("binary").alias("rows"), "answer"))

    def run(group: pa.Table) -> pa.Table:
        rows = [r for r in group["rows"].to_pylist() if r is not None]
        if len(rows) != 1:
            raise ValueError(DIFFER)
        release()
        return finish(group["block"][0].as_py(), from_ipc(rows[0]), [a for a in group["answer"].to_pylist() if a is not None])

    return sides.groupBy("block").applyInArrow(run, schema)
