"""Reading a list of sources, each by its kind, so that one failure stops no other."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.functions.urls import source_kind
from answerloom.operators.images import dominant_colors, read_images
from answerloom.sources import readers

STATUS = "source string, kind string, status string, rows bigint, error string"
_AT_ONCE = 8


def route_sources(df: DataFrame, url: str, into: str = "kind") -> DataFrame:
    """Adds the kind of reader each URL needs."""
    return df.withColumn(into, source_kind(F.col(url)))


def kind_of(path: str) -> str:
    """The reader for a path; the same rules as ``source_kind``."""
    low = path.lower()
    if path.endswith(".pdf"):
        return "pdf"
    if path.endswith(".zip"):
        return "zip"
    if path.endswith(V.TABULAR_SUFFIXES):
        return "file"
    if low.endswith(V.AUDIO_SUFFIXES):
        return "audio"
    if low.endswith(V.IMAGE_SUFFIXES):
        return "image"
    if "/api/" in path or path.endswith("/data"):
        return "api"
    return "page"


def read_source(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """One source as a table. Kinds that need a remote service raise ValueError."""
    kind = kind_of(path)
    if kind == "zip":
        return readers.read_zip_jsonl(spark, path)
    if kind == "image":
        return dominant_colors(read_images(spark, path))
    if kind == "file":
        if path.endswith(".csv"):
            return readers.read_csv_auto(spark, path)
        if path.endswith(".json"):
            return readers.read_json_records(spark, path)
        if path.endswith(".xml"):
            return readers.read_xml_records(spark, path, row_tag)
        if path.endswith(".txt"):
            return readers.read_text_files(spark, path)
    if kind in ("page", "api"):
        return readers.read_text_files(spark, path)
    raise ValueError(f"no reader for {kind} source")


def ingest_manifest(
    spark: SparkSession, sources: Sequence[str], row_tag: str | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables by source, and the status of every source.

    Sources are independent Spark jobs, several at a time.
    """

    def one(path: str) -> tuple[str, DataFrame | None, tuple]:
        kind = kind_of(path)
        try:
            if kind == "zip":
                broken = readers.zip_status(spark.read.format("binaryFile").load(path)).where("status = 'failed'").orderBy("archive", "member").first()
                if broken is not None:
                    return path, None, (path, kind, "failed", None, broken.error)
            df = read_source(spark, path, row_tag)
            return path, df, (path, kind, "success", df.count(), None)
        except Exception as error:  # noqa: BLE001 - reported in the status table
            return path, None, (path, kind, "failed", None, str(error) or type(error).__name__)

    with ThreadPoolExecutor(_AT_ONCE) as pool:
        done = list(pool.map(one, sources))
    frames = {path: df for path, df, _ in done if df is not None}
    return frames, spark.createDataFrame([status for _, _, status in done], STATUS)
