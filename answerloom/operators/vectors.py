"""Cosine similarity: of two columns, top matches of queries, pairs over a threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.plans.staging import cut_lineage

QUERY_BATCH = 1024
BLOCK_ROWS = 2048
DIGITS = 12  # scores closer than this count as equal
_BLOCKS = 24  # blocks of a side, while the values of a block stay below the next number
_BLOCK_VALUES = 1 << 20
_STRIP_SCORES = 1 << 22


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns; null where one is all zero."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, matrix / norms, np.nan)


def _strips(rows: int, columns: int) -> range:
    """Starts of strips of a matrix of scores, of which one at a time is in memory."""
    return range(0, rows, _strip(columns))


def _strip(columns: int) -> int:
    return max(1, _STRIP_SCORES // max(1, columns))


def _best(query_ids, matrix: np.ndarray, ids: np.ndarray, vectors, k: int) -> pd.DataFrame:
    """The k best of some vectors for each query."""
    units = _unit_rows(vectors)
    known = ~np.isnan(units).any(axis=1)
    units, ids, names = units[known], np.asarray(ids)[known], np.asarray(query_ids)
    found = [(np.arange(0), np.arange(0), np.zeros(0))]
    asked = np.flatnonzero(~np.isnan(matrix).any(axis=1)) if len(ids) else np.arange(0)
    for start in _strips(len(asked), len(ids)):
        rows = asked[start : start + _strip(len(ids))]
        scores = matrix[rows] @ units.T
        if k < len(ids):
            # Scores that round to the k-th best one are within a digit of it.
            least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] - 2 * 10.0**-DIGITS
            q, v = np.nonzero(scores >= least[:, None])
        else:
            q, v = np.indices(scores.shape).reshape(2, -1)
        cosines = np.round(scores[q, v], DIGITS)
        order = np.lexsort((ids[v], -cosines, q))
        q, v, cosines = q[order], v[order], cosines[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((rows[q[first]], v[first], cosines[first]))
    q, v, cosines = (np.concatenate(c) for c in zip(*found))
    return pd.DataFrame({"query_id": names[q], "vec_id": ids[v], "cosine": cosines})


def _block_rows(total: int, least: int, size: int) -> int:
    """Rows of a block in a comparison of all blocks with each other.

    A row is copied once to each block that it meets, so blocks grow with the table, up to what a task holds, and the
    copies stay few. ``size`` is the length of a vector.
    """
    return max(least, min(_BLOCK_VALUES // max(1, size), math.ceil(total / _BLOCKS)))


def _dealt(df: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """Dealt out by ``columns`` for work that is heavy per group: a small shuffle is not put together in few tasks."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(tasks, max(least, df.sparkSession.sparkContext.defaultParallelism))), *columns)


def most_similar(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    vector_id: str = "vec_id",
    vector: str = "embedding",
    query_batch: int = QUERY_BATCH,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, vec_id, cosine, place)``: the k vectors closest to each query, ties by id.

    ``queries`` has ``query_id`` and ``query``. Up to ``query_batch`` queries
    go with the tasks, the vectors are read where they lie, and each task
    passes on k rows per query. More queries than that are dealt out in
    blocks, and blocks of queries meet blocks of vectors. ``query_batch`` and ``block_rows`` are the least rows of such
    blocks: every query is compared with every vector, but copies of a row only grow as the number of blocks.
    """
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("vec_id", vectors.schema[vector_id].dataType),
            T.StructField("cosine", T.DoubleType()),
        ]
    )
    slim = vectors.select(F.col(vector_id).alias("vec_id"), F.col(vector).alias("embedding"))
    asked = queries.select("query_id", "query")
    few = asked.limit(query_batch + 1).collect()
    if len(few) <= query_batch:
        names = [r["query_id"] for r in few]
        matrix = _unit_rows([r["query"] for r in few]) if few else None

        def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = None
            for part in parts:
                if part.empty or matrix is None:
                    continue
                found = _best(names, matrix, part["vec_id"].to_numpy(), part["embedding"], k)
                kept = found if kept is None else pd.concat([kept, found])
                kept = kept.sort_values(["query_id", "cosine", "vec_id"], ascending=[True, False, True])
                kept = kept.groupby("query_id").head(k)
            if kept is not None:
                yield kept

        results = slim.mapInPandas(search, schema)
    else:
        size = len(few[0]["query"] or ())
        asked_rows, vector_rows = queries.count(), vectors.count()
        query_blocks = math.ceil(asked_rows / _block_rows(asked_rows, query_batch, size))
        vector_blocks = max(1, math.ceil(vector_rows / _block_rows(vector_rows, block_rows, size)))

        def blocks(column: str, count: int) -> Column:
            return F.pmod(F.xxhash64(column), F.lit(count))

        left = asked.select(
            "*", blocks("query_id", query_blocks).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))).alias("v")
        )
        right = slim.select(
            "*", blocks("vec_id", vector_blocks).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q")
        )

        def meet(some: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            if some.empty or part.empty:
                return pd.DataFrame(columns=schema.names)
            return _best(some["query_id"], _unit_rows(some["query"]), part["vec_id"].to_numpy(), part["embedding"], k)

        q, v = F.col("q").cast("bigint"), F.col("v").cast("bigint")
        tasks = query_blocks * vector_blocks
        left, right = (_dealt(side.withColumns({"q": q, "v": v}), tasks, "q", "v") for side in (left, right))
        results = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInPandas(meet, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return results.withColumn("place", place).where(F.col("place") <= k)


def distinct_vectors(vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each vector once: its smallest id as ``vec_id`` and how many ``copies`` there are."""
    return vectors.groupBy(F.col(vector).alias("embedding")).agg(
        F.min(vector_id).alias("vec_id"), F.count(F.lit(1)).alias("copies")
    )


def _pair_type(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("vec_id", id_type),
            T.StructField("other_id", id_type),
            T.StructField("cosine", T.DoubleType()),
            T.StructField("copies", T.LongType()),
            T.StructField("other_copies", T.LongType()),
        ]
    )


def similar_pairs(
    vectors: DataFrame,
    threshold: float,
    vector_id: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(vec_id, other_id, cosine, copies, other_copies)``: pairs at or over a cosine threshold.

    Copies of a vector are one row, named by their smallest id, with their
    number. The angle is a distance, so two vectors within an angle r cannot
    lie in the regions of two pivots unless each is within 2r of the border;
    only such regions are compared, in blocks of at least ``block_rows`` rows. The number of regions grows with the
    square root of the number of blocks. A low threshold has a wide reach: below about 0.7 (45 degrees) nearly all
    regions meet, and the work is that of comparing all distinct vectors in blocks. A vector is copied to each block that it
    meets, so blocks grow with the table up to a bounded size.
    """
    single = cut_lineage(distinct_vectors(vectors, vector_id, vector))
    total = single.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], _pair_type(vectors.schema[vector_id].dataType))
    block_rows = _block_rows(total, block_rows, len(single.select("embedding").first()[0] or ()))
    blocks = total // block_rows
    count = max(1, min(blocks, 16 * math.isqrt(blocks)))
    # Chosen by hash, out of a few times as many, so that no task sends on more than those.
    some = single.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total))) < 8 * count + 16)
    pivots = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()
    count = len(pivots)
    matrix = _unit_rows([p["embedding"] for p in pivots])
    reach = 2 * math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    region_type = T.StructType(
        [T.StructField("home", T.IntegerType()), T.StructField("others", T.ArrayType(T.IntegerType()))]
    )

    @F.pandas_udf(region_type)
    def regions(column: pd.Series) -> pd.DataFrame:
        angles = np.arccos(np.clip(np.nan_to_num(_unit_rows(column) @ matrix.T), -1.0, 1.0))
        home = angles.argmin(axis=1)
        near = angles - angles[np.arange(len(home)), home][:, None] <= reach
        # A pair in two regions is looked for in the one with the smaller number.
        others = [[int(j) for j in np.flatnonzero(row) if j < h] for row, h in zip(near, home)]
        return pd.DataFrame({"home": home.astype("int32"), "others": others})

    placed = cut_lineage(single.withColumn("r", regions("embedding")).select("*", "r.*").drop("r"))
    sizes = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    visits = {
        r["region"]: r["n"]
        for r in placed.select(F.explode("others").alias("region"))
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    homes = [max(1, math.ceil(sizes.get(i, 0) / block_rows)) for i in range(count)]
    guests = [math.ceil(visits.get(i, 0) / block_rows) for i in range(count)]
    # Blocks of a region: first those of its own vectors, then those of visiting ones.
    home_blocks, guest_blocks = F.array(*map(F.lit, homes)), F.array(*map(F.lit, guests))
    spread = F.abs(F.xxhash64("vec_id"))

    def task(region: Column, left: Column, right: Column, side: int) -> Column:
        return F.struct(
            region.alias("region"), left.cast("int").alias("left"), right.cast("int").alias("right"),
            F.lit(side).alias("side"),
        )

    own = F.get(home_blocks, F.col("home"))
    block = F.pmod(spread, own).cast("int")
    as_left = F.transform(
        F.sequence(block, own + F.get(guest_blocks, F.col("home")) - 1), lambda t: task(F.col("home"), block, t, 0)
    )
    as_right = F.transform(F.sequence(F.lit(0), block), lambda s: task(F.col("home"), s, block, 1))
    visiting = F.flatten(
        F.transform(
            "others",
            lambda i: F.transform(
                F.sequence(F.lit(0), F.get(home_blocks, i) - 1),
                lambda s: task(
                    i, s, F.get(home_blocks, i) + F.pmod(spread, F.get(guest_blocks, i)), 1
                ),
            ),
        )
    )
    work = placed.select(
        "vec_id", "copies", "embedding", F.explode(F.concat(as_left, as_right, visiting)).alias("t")
    ).select("vec_id", "copies", "embedding", "t.*")
    schema = _pair_type(vectors.schema[vector_id].dataType)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["side"] == 0], part[part["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame(columns=schema.names)
        rows, columns, met = _unit_rows(left["embedding"]), _unit_rows(right["embedding"]).T, []
        for start in _strips(len(rows), len(right)):
            scores = rows[start : start + _strip(len(right))] @ columns
            x, y = np.nonzero(scores >= threshold - 2 * 10.0**-DIGITS)
            cosines = scores[x, y]  # as they are: a caller's own rounding must not be the second one
            reached = np.round(cosines, DIGITS) >= threshold
            met.append((x[reached] + start, y[reached], cosines[reached]))
        a, b, cosines = (np.concatenate(c) for c in zip(*met))
        li, ri = left["vec_id"].to_numpy()[a], right["vec_id"].to_numpy()[b]
        same_block = int(part["left"].iloc[0]) == int(part["right"].iloc[0])
        keep = (li < ri) if same_block else (li != ri)
        a, b, cosines, li, ri = a[keep], b[keep], cosines[keep], li[keep], ri[keep]
        flip = li > ri
        lc, rc = left["copies"].to_numpy()[a], right["copies"].to_numpy()[b]
        return pd.DataFrame(
            {
                "vec_id": np.where(flip, ri, li),
                "other_id": np.where(flip, li, ri),
                "cosine": cosines,
                "copies": np.where(flip, rc, lc),
                "other_copies": np.where(flip, lc, rc),
            }
        )

    tasks = sum(h * (h + 1) // 2 + h * g for h, g in zip(homes, guests))
    dealt = _dealt(work, tasks, "region", "left", "right")
    return dealt.groupBy("region", "left", "right").applyInPandas(compare, schema)
