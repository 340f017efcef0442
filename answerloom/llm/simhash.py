"""SimHash fingerprints of texts, and links between those that differ in few bits, by covering locality-sensitive hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.components import components
from answerloom.llm.texts import blocks, flat, lower_ascii, ranges, words
from answerloom.plans.staging import cut_lineage

BITS = 64
SEED = 42
FEW = 64  # fingerprints of a bucket that are compared one by one; larger buckets are split by flipped bits

_P1, _P2, _P3, _P4, _P5 = (  # the primes of XXH64
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the strings data[start : start + length]. Those under 32 bytes go through array operations, longer ones through xxhash."""
    padded = np.zeros(len(data) + 8, np.uint64)
    padded[: len(data)] = data
    two = padded[:-1] | (padded[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    del two
    eight = four[:-4] | (four[4:] << np.uint64(32))
    h = np.uint64(seed) + _P5 + length.astype(np.uint64)
    for k in range(3):
        at = np.flatnonzero(length >= 8 * (k + 1))
        if len(at):
            lane = _rotated(eight[start[at] + 8 * k] * _P2, 31) * _P1
            h[at] = _rotated(h[at] ^ lane, 27) * _P1 + _P4
    at = np.flatnonzero(length & 4)
    h[at] = _rotated(h[at] ^ (four[start[at] + (length[at] & ~7)] * _P1), 23) * _P2 + _P3
    for k in range(3):
        at = np.flatnonzero((length & 3) > k)
        h[at] = _rotated(h[at] ^ (padded[start[at] + (length[at] & ~3) + k] * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    whole = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(length >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(whole[int(start[i]) : int(start[i] + length[i])], seed)
    return h


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every ``n``-word shingle of each text, repeats included, end to end, and how many each text has.

    A text of 1 to n - 1 words has one, its whole sequence.
    """
    data = lower_ascii(data)
    found = words(data, offsets)
    size = found.end - found.start
    begin = np.concatenate(([0], np.cumsum(size + 1)))  # of each word in the words joined by one space
    joined = np.full(int(begin[-1]), 0x20, np.uint8)
    joined[ranges(begin[:-1], size)] = data[ranges(found.start, size)]
    count = np.diff(found.first)
    shingles = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = ranges(found.first[:-1], shingles)  # word that a shingle begins with
    last = np.minimum(first + n, np.repeat(found.first[1:], shingles)) - 1
    return xxh64(joined, begin[first], begin[last] + size[last] - begin[first]), shingles


_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)  # bit i of a byte to byte i


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text the bits that are set in over half of its hashes (uint64; no hashes: zero).

    The bits of one byte are counted in the eight bytes of a long, in runs of at most 255 hashes.
    """
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    some = count[full]
    runs = -(-some // 255)
    first_run = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(some) - some, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first_run, runs))
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[by_byte[:, k]], starts)
        ones = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        bits = np.packbits(2 * ones > some[:, None], axis=1, bitorder="little")[:, 0]
        out[full] |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """Rows (id, print): the 64-bit SimHash of every whole text as a long. Blocks of texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, text):
            hashes, count = shingle_hashes(*flat(table[text]), n)
            found = pa.array(majority(hashes, count).view(np.int64))
            yield from pa.table([table[id_column], found], names=[id_column, "print"]).to_batches()

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, print long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 bit masks: of any ``radius`` bits, some mask holds none.

    Bit i is given a nonzero vector m(i) of radius + 1 bits; the mask of a nonzero vector v holds the bits
    with an odd m(i) . v. The vectors of ``radius`` bits do not span all radius + 1 dimensions, so some v is orthogonal to
    all of them. Two fingerprints that differ in these bits alone agree on its mask.
    """
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs(members: Column, radius: int, few: int) -> Column:
    """The pairs of a short sorted array that differ in at most ``radius`` bits."""
    after = lambda a, i: F.filter(F.slice(members, i + 2, few), lambda b: F.bit_count(a.bitwiseXOR(b)) <= radius)
    return F.flatten(F.transform(members, lambda a, i: F.transform(after(a, i), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def links(prints: DataFrame, radius: int = 2, few: int = FEW) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``prints`` (distinct longs) at ``radius`` bits or fewer, an even number.

    Every fingerprint goes to one bucket per covering mask: its bits under the mask. A pair within the radius meets in
    some bucket. Buckets are counted first and only shared ones go on. One of up to ``few`` fingerprints
    is compared pair by pair. In a larger one each fingerprint is listed under itself and under every value that it becomes by
    flipping up to radius / 2 of the bits outside the mask: two within the radius share such a value, and all that share one
    are within the radius of each other, so a chain through its smallest one links them. That is linear in the bucket, of
    any size, and spread by the value; a list is no longer than a ball of radius / 2.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for k, m in enumerate(masks))))
    placed = prints.select("print", at.alias("at")).select("print", "at.mask", "at.bucket")
    shared = placed.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(placed.join(shared, ["mask", "bucket"]))
    near = met.where(F.col("n") <= few).groupBy("mask", "bucket").agg(F.sort_array(F.collect_list("print")).alias("m"))
    near = near.select(F.explode(_pairs(F.col("m"), radius, few)).alias("p")).select("p.a", "p.b")

    def flipped(mask: int) -> Column:
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        flips = [_signed(sum(c)) for k in range(radius // 2 + 1) for c in itertools.combinations(free, k)]
        return F.transform(F.array(*(F.lit(f).cast("long") for f in flips)), lambda f: F.col("print").bitwiseXOR(f))

    crowded = met.where(F.col("n") > few)
    values = F.coalesce(*(F.when(F.col("mask") == k, flipped(m)) for k, m in enumerate(masks)))
    balls = crowded.select("mask", "print", F.explode(values).alias("value")).groupBy("mask", "value").agg(F.collect_list("print").alias("m"))
    balls = balls.where(F.size("m") > 1).withColumn("a", F.array_min("m")).select("a", F.explode("m").alias("b")).where("a <> b")
    return near.unionByName(balls)


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 3, radius: int = 2, few: int = FEW) -> DataFrame:
    """Per row: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links.

    A-Z are lower-cased, words are runs of bytes other than space and 0x09-0x0D. A bit of the fingerprint is 1 if it is
    set in over half of the XXH64 hashes (seed 42) of the text's ``n``-word shingles, joined by spaces, repeats included (fewer
    words: the whole sequence). Null, empty and blank texts have fingerprint zero, which links like any other. A text of any length is
    hashed whole, in one task. Rows link at ``radius`` differing bits or fewer; equal fingerprints are compared once and repeated
    rows stay rows each. Null ids are passed over in component_id, which is null if a component has no other. Ids
    may be of any type with an order. Other columns, whatever their names, are not carried; an empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(df, id_column, text, n).withColumnRenamed(id_column, "id"))
    distinct = cut_lineage(rows.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    tied = components(links(distinct.select("print"), radius, few)).withColumnsRenamed({"node": "print"})
    known = distinct.join(tied, "print", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "print"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("print", "component_id", F.lit(True).alias("linked"))
    whole = rows.join(known, "print", "left")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return whole.select(
        F.col("id").alias(id_column), hexed.alias("fingerprint"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
