"""Blocks of texts as flat byte arrays, and the words in them.

Python tasks here work on blocks: some MB of whole texts, laid end to end as UTF-8 bytes.
Splitting, numbering and hashing of words are array operations over a whole block; only
the distinct words of a block ever become Python objects.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20  # text of one block; a longer single text is a block of its own
BLOCK_ROWS = 1 << 20  # rows of one block, as empty texts have no bytes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))
_BYTE_CODES = np.random.default_rng(20240229).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroups rows so that each block holds at most ``most`` bytes of text (null: none), or one row, and BLOCK_ROWS rows.

    Where blocks end depends on the rows alone, not on the batches they come in.
    """
    held, size, rows = [], 0, 0
    for batch in batches:
        total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        begin, before = 0, 0
        while begin < len(total):
            end = int(np.searchsorted(total, before + most - size, "right"))
            end = min(end, begin + BLOCK_ROWS - rows)
            if not held and end <= begin:
                end = begin + 1
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                size += int(total[end - 1]) - before
                rows += end - begin
                begin, before = end, int(total[end - 1])
            if begin < len(total):
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, rows = [], 0, 0
                release()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    del held
    release()


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and where each begins (one more entry); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    """All words of a block in order. ``first``: number of the first word of each document, one more at the end."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray
    names: pa.Array  # distinct words as binary, by code

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array over bytes that lie end to end. ``starts`` has one entry more than there are strings."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of bytes other than space and 0x09-0x0D, never across documents."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(offsets), np.int64), np.zeros(0, np.int32), pa.array([], pa.large_binary()))
    gap = _SPACE[data]
    kept = data[~gap]
    begins = ~gap
    begins[1:] &= gap[:-1]
    cuts = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    begins[cuts] = ~gap[cuts]
    stops = ~gap
    stops[:-1] &= gap[1:]
    stops[cuts - 1] = ~gap[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    coded = strings(kept, at).dictionary_encode()
    return Words(start, end, np.searchsorted(start, offsets), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


def hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each binary string, from its bytes alone (the same in every task)."""
    data, at = flat(names)
    length = np.diff(at)
    out = np.zeros(len(length), np.uint64)
    if not len(data):
        return mix(out)
    power = np.full(int(length.max()), _STEP, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    place = np.arange(len(data)) - np.repeat(at[:-1], length)
    terms = mix(_BYTE_CODES[data] * power[place])
    full = length > 0
    out[full] = np.add.reduceat(terms, at[:-1][full])
    return mix(out + length.astype(np.uint64) * _STEP)


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values (uint64); one per place, the last n - 1 left out."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    count = len(values) - n + 1
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = mix(total + values[k : k + count]) + _STEP
    return mix(total)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, end to end."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - before, lengths)


def code_points_before(data: np.ndarray) -> np.ndarray:
    """Number of characters that begin before each byte (one entry more than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
