"""Readers: CSV with or without header, JSON, XML, text, zipped JSON lines."""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINES_PER_BATCH = 10_000
_COLUMN_TYPES = {r"\bOBJECT<": "STRUCT<", r"\bVOID\b": "STRING", r"\bDECIMAL\(\d+,\d+\)": "DOUBLE"}


def looks_like_data(header: str | None) -> bool:
    """A first header cell that is a number: digits, or digits with one dot."""
    return bool(header) and header.replace(".", "", 1).isdigit()


def _first_lines(spark: SparkSession, path: str) -> list:
    """One row per file: its path and first line. Files are split, so the first line is that of the split that begins the file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value"
    )
    return lines.groupBy("file").agg(F.min_by("value", F.struct("at", "n")).alias("line")).orderBy("file").collect()


def _read_csv(spark: SparkSession, files: list[str], header: bool, schema) -> DataFrame:
    reader = spark.read.option("header", header)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(files)


def read_csv_auto(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, or without one (``value_0``, ``value_1``, ...) when the first cell is a number.

    Each file is judged by its own first line (the driver gets one line per file). Files with the same header are read together;
    different ones are put together by column name, a file without a header by position if there is one
    header only and it is as long. Types are inferred, which reads the files once more; give a schema to avoid that.
    """
    by_header: dict[str | None, list[str]] = {}
    for row in _first_lines(spark, path):
        cell = spark_csv_first(row.line)
        by_header.setdefault(None if looks_like_data(cell) else row.line, []).append(row.file)
    if not by_header:
        return spark.read.schema(schema).csv(path) if schema is not None else spark.read.csv(path)
    if schema is not None:
        parts = [_read_csv(spark, files, line is not None, schema) for line, files in by_header.items()]
    else:
        parts = [_read_csv(spark, files, True, None) for line, files in by_header.items() if line is not None]
        if None in by_header:
            bare = _read_csv(spark, by_header[None], False, None)
            same = len(parts) == 1 and len(parts[0].columns) == len(bare.columns)
            parts.append(bare.toDF(*(parts[0].columns if same else [f"value_{i}" for i in range(len(bare.columns))])))
    return _together(parts)


def spark_csv_first(line: str) -> str:
    """The first cell of a CSV line."""
    return next(csv.reader([line]), [""])[0].strip() if line else ""


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds both: numbers as the wider number, structs field by field, else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a}
        for f in b:
            fields[f.name] = _wider(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_wider(a.elementType, b.elementType))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        whole = isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)
        return T.LongType() if whole else T.DoubleType()
    return T.StringType()


def _together(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts by column name; a column of several types takes one that holds them all."""
    kinds: dict[str, T.DataType] = {}
    for part in parts:
        for f in part.schema:
            kinds[f.name] = _wider(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    cast = [
        p.select(*(F.to_json(F.col(f"`{c}`")).alias(c) if isinstance(kinds[c], T.StringType) and isinstance(p.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in p.columns))
        for p in parts
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON array gives a row per element, a single object one row, a file of lines a row per object.

    Each file is judged by itself: lines if one of them is a whole object and none opens or closes a larger
    value (the driver gets two counts per file). A line that is no object, in a file of lines, is a row of nulls.
    """
    line = F.trim("value")
    whole = line.startswith("{") & F.try_parse_json(line).isNotNull()
    edge = line.startswith("[") | line.isin("{", "}", "]", "},", "],")
    files = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("file"), whole.alias("whole"), edge.alias("edge"))
        .groupBy("file")
        .agg(F.count_if("whole").alias("objects"), F.count_if("edge").alias("edges"))
        .collect()
    )
    by_lines: dict[bool, list[str]] = {}
    for row in sorted(files, key=lambda r: r.file):
        by_lines.setdefault(row.objects > 0 and row.edges == 0, []).append(row.file)
    if not by_lines:
        return (spark.read.schema(schema) if schema is not None else spark.read).json(path)
    reader = lambda lines: spark.read.option("multiLine", not lines)
    if schema is None:
        parts = [reader(lines).json(names) for lines, names in by_lines.items()]
        kinds = [p.schema for p in parts]
        schema = reduce(_wider, kinds)
        if all(kind == schema for kind in kinds):  # else all are read again, as what holds them all
            return reduce(DataFrame.unionByName, parts)
    parts = [reader(lines).schema(schema).json(names) for lines, names in by_lines.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _record_tags(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in files:
        tags: dict[str, None] = {}
        for text in part["value"]:
            depth = 0
            try:
                for event, element in ElementTree.iterparse(io.BytesIO(text.encode()), ("start", "end")):
                    depth += 1 if event == "start" else -1
                    if event == "start" and depth == 2:
                        tags.setdefault(element.tag)
                    if event == "end":
                        element.clear()
            except ElementTree.ParseError:
                pass  # what came before the break counts
        yield pd.DataFrame({"tag": list(tags)}, dtype=object)


def read_xml_records(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """One row per record element, fields as text; without records the whole text as ``xml_text``.

    Without a ``row_tag`` every child of a root is a record, whatever its tag; one pass over the files finds
    the tags, of which the driver gets the distinct ones.
    """
    tags = [row_tag]
    if row_tag is None:
        found = spark.read.text(path, wholetext=True).mapInPandas(_record_tags, "tag string").distinct()
        tags = [r.tag for r in found.orderBy("tag").collect()]
    parts = [spark.read.format("xml").option("rowTag", tag).option("inferSchema", False).load(path) for tag in tags]
    parts = [p for p in parts if p.columns]
    return _together(parts) if parts else spark.read.text(path, wholetext=True).withColumnRenamed("value", "xml_text")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text, content)``: the text of each file; where it is not UTF-8 the bytes instead."""
    files = spark.read.format("binaryFile").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(
        "path", text.alias("text"), F.when(text.isNull(), F.col("content")).alias("content")
    )


_MEMBER_LINES = "archive string, member string, line_no bigint, line string, raw binary, error string"


def zip_members(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(archive, member, line_no, line, raw, error)``: the non-empty lines of every member of every archive.

    Members are read as a stream and passed on in batches. ``line`` is null and ``raw`` holds the bytes where a line is not
    UTF-8. A broken archive or member (not a zip, damaged, locked) gives a row with its ``error`` and no line, after the lines
    read before the damage; the others go on.
    """
    columns = ["archive", "member", "line_no", "line", "raw", "error"]

    def member_rows(archive: str, opened: zipfile.ZipFile, member: str) -> Iterator[tuple]:
        try:
            with opened.open(member) as stream:
                for number, raw in enumerate(stream):
                    if raw.strip():
                        try:
                            yield archive, member, number, raw.decode("utf-8").strip(), None, None
                        except UnicodeDecodeError:
                            yield archive, member, number, None, raw, None
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError) as error:
            yield archive, member, None, None, None, str(error) or type(error).__name__

    def archive_rows(archive: str, data: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as opened:
                for member in opened.namelist():
                    yield from member_rows(archive, opened, member)
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError) as error:
            yield archive, None, None, None, None, str(error) or type(error).__name__

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = (row for archive, data in zip(part[path], part[content]) for row in archive_rows(archive, data))
            while batch := list(islice(rows, _LINES_PER_BATCH)):
                yield pd.DataFrame(batch, columns=columns).astype({"line_no": "Int64"})

    return archives.select(path, content).mapInPandas(lines, _MEMBER_LINES)


def zip_lines(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(archive, member, line_no, line)`` of the lines that can be read; ``zip_status`` tells of the others."""
    return zip_members(archives, path, content).where("line IS NOT NULL").drop("raw", "error")


def zip_status(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(archive, member, status, lines, error)`` per archive and member: ``failed`` where it broke, or a line was not UTF-8."""
    rows = zip_members(archives, path, content)
    said = F.coalesce("error", F.when(F.col("raw").isNotNull(), "a line is not UTF-8"))
    found = rows.groupBy("archive", "member").agg(F.count("line").alias("lines"), F.min(said).alias("error"))
    return found.select("archive", "member", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "lines", "error")


def parse_json_lines(lines: DataFrame, column: str = "line", schema: T.StructType | str | None = None) -> DataFrame:
    """JSON objects to columns, the union of their keys; lines that are no object are dropped.

    Without a schema one pass over the lines finds it.
    """
    objects = lines.where(F.col(column).startswith("{") & F.try_parse_json(column).isNotNull())
    if schema is None:
        found = objects.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]
        if not found or not found.startswith("OBJECT<"):
            return objects.drop(column)
        for variant_type, column_type in _COLUMN_TYPES.items():
            found = re.sub(variant_type, column_type, found)
        schema = found
    kept = [c for c in lines.columns if c != column]
    return objects.select(*kept, F.from_json(column, schema).alias("__r")).select(*kept, "__r.*")


def read_zip_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The JSON lines of every member of every archive below a path."""
    return parse_json_lines(zip_lines(spark.read.format("binaryFile").load(path)), schema=schema)
