"""Where intermediate results are kept so that a lost executor costs no work.

The cluster names a shared folder in ``spark.checkpoint.dir``. Only when that
setting is absent (tests, a laptop) is a folder of our own made.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, also set as the checkpoint folder of the session."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="answerloom-"))
    return sc.getCheckpointDir()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; never reused, so never overwritten."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, read from a table just written to the shared folder.

    A lost executor then costs no earlier work, the plan is a plain scan, and
    Catalyst knows the true size, so it can choose to broadcast it or not.
    """
    path = stage_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for what is read more than once; a plain scan of files, as that gives, is left as it is."""
    return df if df._jdf.queryExecution().optimizedPlan().nodeName() == "LogicalRelation" else cut_lineage(df)


def cut_in_buckets(df: DataFrame, columns: Sequence[str], buckets: int) -> DataFrame:
    """As ``cut_lineage``, in buckets by ``columns``: joins on exactly these columns do not shuffle this table.

    The rows of a bucket are in no order: Spark sorts them again when it wants one, and the order took most of the writing.
    Spark keeps buckets only of tables with a name. The name is dropped at once; the files stay, and what is returned reads them.
    """
    spark = df.sparkSession
    name = f"answerloom_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *columns)  # as buckets are, so that a task writes one file
    dealt.write.bucketBy(buckets, *columns).option("path", stage_path(spark, "buckets")).saveAsTable(name)
    table = spark.table(name).select(*df.columns)
    spark.sql(f"DROP TABLE {name}")
    return table
