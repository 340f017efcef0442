"""Exact top-k inner products: norm-bucketed retrieval with length and coordinate pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.plans.staging import cut_lineage

BUCKET = 4096  # vectors in a bucket
QUERIES = 512  # queries in a block
_PACKED = "n int, width int, longest double, shortest double, ids binary, cells binary"


def integer_vectors(df: DataFrame, vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    cells = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return F.when(x.isNotNull() & ~odd, cells)


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        ids = table["id"].to_numpy().astype(np.int64)
        lists = table["cells"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lengths = np.asarray(pc.list_value_length(lists), np.int64)
        width = int(lengths.max())
        grid = np.zeros((len(ids), width), np.int64)  # shorter vectors end in zeros
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        grid[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        if len(flat) and np.abs(flat).max() > 2**28:
            raise ValueError("components beyond 2^28 would overflow a score")
        length = np.sqrt((grid.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -length))
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            yield pa.RecordBatch.from_pydict(
                {
                    "n": pa.array([len(rows)], pa.int32()),
                    "width": pa.array([width], pa.int32()),
                    "longest": [float(length[rows[0]])],
                    "shortest": [float(length[rows[-1]])],
                    "ids": [ids[rows].tobytes()],
                    "cells": [grid[rows].astype(np.int32).tobytes()],
                }
            )

    return run


def _grid(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    n, width = row[f"{prefix}n"], row[f"{prefix}width"]
    return np.frombuffer(row[f"{prefix}ids"], np.int64), np.frombuffer(row[f"{prefix}cells"], np.int32).reshape(n, width)


def _padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    grow = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return grow(a), grow(b)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = ids != own
    scores, ids = scores[keep], ids[keep]
    if len(scores) > 4 * k:  # all that tie with the k-th stay
        keep = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def bucket_search(q_ids, queries, ids, cells, floor, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its best rows of one bucket among those that can reach ``floor`` (its k-th best score so far).

    With |p| the longest vector, only rows of cosine >= t = floor / (|q| |p|) count. t > 1 drops
    the bucket. From 0.4 on, coordinate pruning: on the query's largest coordinate, a unit vector
    with cosine >= t lies within sqrt((1 - c^2)(1 - t^2)) of c t, so a binary search in that
    coordinate's sorted list gives the rows to verify. Below, length pruning: a prefix of the bucket,
    which is sorted by length, downwards. Survivors are verified by exact integer products.
    """
    length = np.sqrt((cells.astype(np.float64) ** 2).sum(1))
    wide = cells.astype(np.int64)
    unit = cells / np.maximum(length, 1e-300)[:, None]
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q_id, q, least in zip(q_ids, queries.astype(np.int64), floor):
        size = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        rows = slice(None)
        if least > 0 and size > 0 and len(ids):
            t = least / (size * length[0]) * (1 - 1e-9) if length[0] else 2.0
            if t > 1:
                continue
            if t >= 0.4:
                focus = int(np.argmax(np.abs(q)))
                if focus not in lists:
                    order = np.argsort(unit[:, focus], kind="stable")
                    lists[focus] = order, unit[order, focus]
                order, values = lists[focus]
                c = q[focus] / size
                slack = np.sqrt(max(0.0, 1 - c * c) * max(0.0, 1 - t * t)) + 1e-9
                low = -2.0 if c < -t else c * t - slack  # beyond the cap's centre every value counts
                high = 2.0 if c > t else c * t + slack
                rows = order[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]
                rows = rows[length[rows] * size >= least * (1 - 1e-9)]
            else:
                rows = slice(0, int(np.searchsorted(-length, -least / size * (1 - 1e-9), "right")))
        picked = ids[rows]
        if len(picked):
            yield int(q_id), *_best(wide[rows] @ q, picked, q_id, k)


def _floors(k: int):
    """Adds to each block of queries the k-th best score within one bucket (lowest long, where it has fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, queries = _grid(row, "")
                ids, cells = _grid(row, "b_")
                queries, cells = _padded(queries, cells)
                floor = np.full(len(q_ids), np.iinfo(np.int64).min)
                wide = cells.astype(np.int64)
                for i, (own, q) in enumerate(zip(q_ids, queries.astype(np.int64))):
                    scores, _ = _best(wide @ q, ids, own, k)
                    if len(scores) == k:
                        floor[i] = scores[-1]
                size = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
                need = np.where(floor > 0, floor / np.maximum(size, 1e-300), 0.0)
                kept = {c: row[c] for c in ("n", "width", "ids", "cells")}
                yield pa.RecordBatch.from_pylist(
                    [{**kept, "floor": floor.tobytes(), "least": float(need.min()) * (1 - 1e-9)}],
                    pa.schema([("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("floor", pa.binary()), ("least", pa.float64())]),
                )

    return run


def _verify(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q_ids, queries = _grid(row, "")
                ids, cells = _grid(row, "b_")
                queries, cells = _padded(queries, cells)
                found = list(bucket_search(q_ids, queries, ids, cells, np.frombuffer(row["floor"], np.int64), k))
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array(np.concatenate([np.full(len(s), q) for q, s, _ in found]) if found else [], pa.int64()),
                        "vec_id": pa.array(np.concatenate([i for _, _, i in found]) if found else [], pa.int64()),
                        "score": pa.array(np.concatenate([s for _, s, _ in found]) if found else [], pa.int64()),
                    }
                )

    return run


def top_k(
    df: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024,
    bucket: int = BUCKET, query_block: int = QUERIES,
) -> DataFrame:
    """For each query row its ``k`` highest integer inner products: query_id, rank, vec_id, score.

    All rows but the query's own are candidates; ties go to the smaller id, fewer candidates
    give fewer rows. Vectors (or ids) that are null or hold null or non-finite components take no part;
    vectors that are too short end in zeros; an empty vector scores 0. Rows repeated under
    one id are candidates each; a repeated query id counts once (its first vector by value). An empty table gives no
    rows. Components beyond 2^28 after scaling raise.

    Rows are range-partitioned by length and packed into buckets of ``bucket`` vectors. The bucket of the longest
    vectors (one row of bounded size) gives every query a first lower bound of its k-th score. Queries
    then meet, block by block, the buckets whose longest vector can still reach that bound;
    buckets are spread over columns, blocks of queries go to each column.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("id"), integer_vectors(df, vector, scale).alias("cells"), is_query.alias("q"))
    rows = rows.where("id is not null and cells is not null")
    rows = rows.withColumn("norm", F.aggregate("cells", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    rows = cut_lineage(rows)
    count = rows.count()
    parts = max(1, -(-count // bucket))
    buckets = rows.drop("q").repartitionByRange(parts, F.desc("norm"), "id").mapInArrow(_pack(bucket), _PACKED)
    buckets = cut_lineage(buckets.withColumn("bucket", F.monotonically_increasing_id()))
    asked = rows.where("q").groupBy("id").agg(F.min("cells").alias("cells"))
    asked = asked.repartition(max(1, -(-count // (100 * query_block))), "id")
    asked = asked.mapInArrow(_pack(query_block), _PACKED)
    named = lambda d: d.select(*(F.col(c).alias(f"b_{c}") for c in ("n", "width", "longest", "ids", "cells")), "bucket")
    first = named(buckets.orderBy(F.desc("longest"), "bucket").limit(1))
    schema = "n int, width int, ids binary, cells binary, floor binary, least double"
    asked = cut_lineage(asked.join(F.broadcast(first), F.lit(True)).mapInArrow(_floors(k), schema))  # one bucket: at most 4,096 vectors
    columns = max(1, min(parts, 4 * spark.sparkContext.defaultParallelism))
    asked = asked.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    met = named(buckets).withColumn("col", F.pmod("bucket", F.lit(columns)).cast("int")).join(asked, "col").where("b_longest >= least")
    found = met.drop("col").mapInArrow(_verify(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
