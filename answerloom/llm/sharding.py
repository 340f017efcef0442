"""Proportional stratified interleaving of rows into shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.plans.staging import cut_lineage

CELLS = 1024  # parts in which the rows of a source are ranked, and bands of the common order


def interleave(
    df: DataFrame, stratum: Column, key: Column, shards: int = 40, seed: int = 17, ties: list[str] | None = None, cells: int = CELLS
) -> DataFrame:
    """The rows of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in a shard).

    Rows are shuffled by an md5 of seed and key and ranked within their stratum; sorting by
    (rank - u) / rows of the stratum, u fixed per stratum between 0 and 1, interleaves the strata
    in proportion, and equal cuts of that order give shards whose row counts are at most one
    apart and which all hold every stratum in proportion, to within one row or two.

    No stratum is ranked in one task: the shuffle key deals it into ``cells`` parts, ranked
    apart and added up; the common order is numbered by bands in the same way. Null strata
    form a stratum, null keys are shuffled together; rows alike in every column of ``ties`` may
    change places. No rows give no rows. Columns of ``df`` keep their names; ours begin with
    ``_il_``, but for ``shard`` and ``slot``, which replace columns of those names.
    """
    order = [F.col("_il_md5"), *(F.col(c) for c in (ties or []))]
    rows = df.drop("shard", "slot").withColumns(
        {
            "_il_stratum": F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit("")),
            "_il_md5": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))),
        }
    )
    hex_number = lambda c, digits: F.conv(F.substring(c, 1, digits), 16, 10).cast("long")
    rows = cut_lineage(rows.withColumn("_il_cell", F.floor(hex_number(F.col("_il_md5"), 4) * cells / F.lit(65536)).cast("int")))
    cell = ["_il_stratum", "_il_cell"]
    counts = rows.groupBy(*cell).agg(F.count("*").alias("_il_n"))
    by_cell = Window.partitionBy("_il_stratum").orderBy("_il_cell")
    counts = counts.select(
        *cell,
        (F.sum("_il_n").over(by_cell) - F.col("_il_n")).alias("_il_before"),
        F.sum("_il_n").over(Window.partitionBy("_il_stratum")).alias("_il_size"),
    )
    u = hex_number(F.md5(F.col("_il_stratum")), 8) / F.lit(4294967296.0)
    ranked = (
        rows.withColumn("_il_rank", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
        .join(counts, cell)
        .withColumn("_il_place", (F.col("_il_before") + F.col("_il_rank") - u) / F.col("_il_size"))
        .drop("_il_rank", "_il_before", "_il_size", "_il_cell")
        .withColumn("_il_band", F.floor(F.col("_il_place") * cells).cast("int"))
    )
    ranked = cut_lineage(ranked)
    bands = ranked.groupBy("_il_band").agg(F.count("*").alias("_il_n"))
    bands = bands.select(  # at most one row per band
        "_il_band",
        (F.sum("_il_n").over(Window.orderBy("_il_band")) - F.col("_il_n")).alias("_il_before"),
        F.sum("_il_n").over(Window.partitionBy()).alias("_il_total"),
    )
    in_band = Window.partitionBy("_il_band").orderBy("_il_place", "_il_stratum", *order)
    numbered = (
        ranked.withColumn("_il_rank", F.row_number().over(in_band))
        .join(bands, "_il_band")
        .withColumn("_il_at", F.col("_il_before") + F.col("_il_rank") - 1)
        .withColumn("shard", F.expr(f"cast(_il_at * {shards} div _il_total as int)"))
        .withColumn("slot", F.expr(f"_il_at - (shard * _il_total + {shards - 1}) div {shards}"))
    )
    return numbered.drop(*(c for c in numbered.columns if c.startswith("_il_")))
