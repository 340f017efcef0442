"""Cleaning, typing, profiling and reshaping of tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.functions.text import strip

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_TIME = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}.*)?$"


def clean_names(names: Sequence[str]) -> list[str]:
    """Trimmed, lower case, blanks to underscores; a repeated name gets _2, _3."""
    taken: set[str] = set()
    out = []
    for name in names:
        base = re.sub(r"\s+", "_", name.strip().lower())
        unique, n = base, 1
        while unique in taken:
            n += 1
            unique = f"{base}_{n}"
        taken.add(unique)
        out.append(unique)
    return out


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _after_first(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.slice(array, F.lit(2), F.size(array)))


def _as_number(text: Column) -> Column:
    clean = strip(text)
    return F.when(clean.rlike(_NUMBER), clean.try_cast("double"))


def _as_time(text: Column) -> Column:
    clean = strip(text)
    return F.when(clean.rlike(_TIME), clean.try_cast("timestamp_ntz"))


def infer_types(df: DataFrame, mode: str = "infer") -> DataFrame:
    """Types for text columns.

    ``infer``: a column becomes double when every value is a number, else a
    timestamp when every value is one, else it stays text. Blank counts as
    missing. ``coerce``: every text column becomes double, anything else null.
    The test is one aggregate over all columns.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if mode == "coerce":
        return df.withColumns({c: _as_number(_quoted(c)) for c in texts})
    if mode != "infer":
        raise ValueError(f"mode is 'infer' or 'coerce', not {mode!r}")
    if not texts:
        return df
    tests = []
    for i, name in enumerate(texts):
        column = _quoted(name)
        present = column.isNotNull() & (strip(column) != "")
        tests += [
            F.count_if(present).alias(f"n{i}"),
            F.count_if(present & _as_number(column).isNull()).alias(f"num{i}"),
            F.count_if(present & _as_time(column).isNull()).alias(f"time{i}"),
        ]
    found = df.agg(*tests).first()
    changes = {}
    for i, name in enumerate(texts):
        if found[f"n{i}"] and not found[f"num{i}"]:
            changes[name] = _as_number(_quoted(name))
        elif found[f"n{i}"] and not found[f"time{i}"]:
            changes[name] = _as_time(_quoted(name))
    return df.withColumns(changes) if changes else df


def missing_report(df: DataFrame) -> DataFrame:
    """``(column, missing, total)``: nulls and NaN per column, and in all."""
    counts = []
    for f in df.schema:
        gone = _quoted(f.name).isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            gone = gone | F.isnan(_quoted(f.name))
        counts.append(F.count_if(gone))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.get(F.col("n"), F.lit(i)).alias("missing"))
                      for i, c in enumerate(df.columns)])
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return (
        df.agg(F.array(*counts).alias("n"))
        .select(F.explode(pairs).alias("p"), total.alias("total"))
        .select("p.*", "total")
    )


def fill_missing(df: DataFrame) -> DataFrame:
    """Empty text for missing text; missing numbers stay missing."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.coalesce(_quoted(c), F.lit("")) for c in texts}) if texts else df


# Stand-ins for a line end and a comma inside quotes. Where a text has such characters itself, they are escaped first.
_QUOTED_NEWLINE, _QUOTED_COMMA, _ESCAPE = "\x01", "\x02", "\x03"
_OWN = {_ESCAPE: _ESCAPE + "3", _QUOTED_NEWLINE: _ESCAPE + "1", _QUOTED_COMMA: _ESCAPE + "2"}


def _escaped(text: Column) -> Column:
    for own, escape in _OWN.items():
        text = F.replace(text, F.lit(own), F.lit(escape))
    return text


def _unescaped(text: Column) -> Column:
    for own, escape in reversed(_OWN.items()):
        text = F.replace(text, F.lit(escape), F.lit(own))
    return text


def _numbered(names: Column) -> Column:
    """Repeated names get _2, _3."""

    def name(n: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == n))
        return F.when(before > 0, F.concat(n, F.lit("_"), (before + 1).cast("string"))).otherwise(n)

    return F.transform(names, name)


def _csv_lines(text: Column) -> Column:
    """Non-empty lines; line ends and commas inside quotes are replaced by stand-ins."""
    parts = F.split(F.replace(_escaped(text), F.lit("\r\n"), F.lit("\n")), '"')
    guarded = F.transform(
        parts,
        lambda part, i: F.when(i % 2 == 1, F.translate(part, "\n,", _QUOTED_NEWLINE + _QUOTED_COMMA)).otherwise(part),
    )
    return F.filter(F.split(F.array_join(guarded, '"'), "\n"), lambda line: line != "")


def _csv_cells(line: Column) -> Column:
    return F.transform(
        F.split(F.translate(line, _QUOTED_NEWLINE, "\n"), ","),
        lambda c: _unescaped(
            F.when(
                c.startswith('"') & c.endswith('"') & (F.length(c) > 1),
                F.translate(
                    F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')), _QUOTED_COMMA, ","
                ),
            ).when(c != "", c)
        ),
    )


def coerce_payloads(df: DataFrame, column: str) -> DataFrame:
    """Raw payload texts to records.

    A JSON array gives a record per element, a JSON object one record, any
    other text is read as CSV with a header line. ``record`` is a map of field
    to text, ``pos`` its place in the payload. A payload that gives no record
    keeps one row with a null record and ``kind`` ``rejected``. Repeated header names are numbered
    (``a``, ``a_2``).
    """
    text, is_json = F.col("__text"), F.col("__is_json")
    json_many = F.from_json(F.when(is_json & text.startswith("["), text), "array<map<string,string>>")
    json_one = F.from_json(F.when(is_json & text.startswith("{"), text), "map<string,string>")
    told = df.withColumn("__text", strip(F.col(column)))
    told = told.withColumn("__is_json", text.rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull())
    split = told.withColumns(
        {
            "__json": F.coalesce(json_many, F.array_compact(F.array(json_one))),
            "__lines": F.when(~is_json, _csv_lines(text)),
        }
    )
    csv = F.when(F.size("__lines") > 1, F.col("__lines"))
    parsed = split.withColumns(
        {"__head": _csv_cells(F.get(csv, F.lit(0))), "__rows": F.transform(_after_first(csv), _csv_cells)}
    )
    parsed = parsed.withColumn("__head", _numbered(F.col("__head")))
    ragged = F.exists("__rows", lambda r: F.size(r) > F.size("__head"))
    filled = F.transform(
        "__rows",
        lambda r: F.map_from_entries(
            F.transform(
                F.filter(
                    F.arrays_zip(F.col("__head").alias("k"), r.alias("v")),
                    lambda e, i: e["k"].isNotNull() & (F.array_position(F.col("__head"), e["k"]) == i + 1),
                ),
                lambda e: F.struct(e["k"], e["v"]),
            )
        ),
    )
    records = F.when(F.size("__json") > 0, F.col("__json")).when(~ragged, filled)
    kind = F.when(F.size("__json") > 0, "json").when(F.size(records) > 0, "csv").otherwise("rejected")
    shown = parsed.withColumns({"kind": kind, "__records": records})
    return shown.select(*df.columns, "kind", F.posexplode_outer("__records").alias("pos", "record"))


def promote_header(df: DataFrame, cells: str) -> DataFrame:
    """Rows of text cells, the first one naming the columns, to ``(row, col, name, value)``."""
    head = F.get(F.col(cells), F.lit(0))
    body = _after_first(F.col(cells))
    listed = F.flatten(
        F.transform(
            body,
            lambda row, i: F.transform(
                F.arrays_zip(head.alias("name"), row.alias("value")),
                lambda cell, j: F.struct(i.alias("row"), j.alias("col"), cell["name"].alias("name"),
                                         cell["value"].alias("value")),
            ),
        )
    )
    kept = [c for c in df.columns if c != cells]
    return df.select(*kept, F.explode(listed).alias("c")).select(*kept, "c.*")


def promoted_table(df: DataFrame, cells: str, names: Sequence[str]) -> DataFrame:
    """The same as columns, for tables known to have the header ``names``."""
    kept = [c for c in df.columns if c != cells]
    body = df.select(*kept, F.posexplode(_after_first(F.col(cells))).alias("row", "__r"))
    return body.select(*kept, "row", *[F.get("__r", F.lit(i)).alias(n) for i, n in enumerate(names)])


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: type, rows, missing, distinct values, least and greatest value.

    Exact distinct values are counted column by column: in one aggregate every row would be held once per column, with all columns.
    """

    def distinct(c: Column) -> Column:
        if not exact:
            return F.approx_count_distinct(c)
        return df.select(c.alias("v")).distinct().agg(F.count("v")).scalar()

    parts, counts = [], []
    for i, f in enumerate(df.schema):
        c = _quoted(f.name)
        parts += [
            F.count(c).alias(f"n{i}"),
            F.min(c).cast("string").alias(f"lo{i}"),
            F.max(c).cast("string").alias(f"hi{i}"),
        ]
        (counts if exact else parts).append(distinct(c).alias(f"d{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("rows"),
                (F.col("rows") - F.col(f"n{i}")).alias("missing"),
                F.col(f"d{i}").alias("distinct"),
                F.col(f"lo{i}").alias("minimum"),
                F.col(f"hi{i}").alias("maximum"),
            )
            for i, f in enumerate(df.schema)
        ]
    )
    told = df.agg(F.count(F.lit(1)).alias("rows"), *parts).select("*", *counts)
    return told.select(F.explode(rows).alias("p")).select("p.*")


def sample_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows by a stated order."""
    return df.orderBy(*order).limit(n)


@dataclass
class RecordSpec:
    """What to do to a table before it is written as records."""

    select: Sequence[str] = ()
    rename: Mapping[str, str] = field(default_factory=dict)
    trim: Sequence[str] = ()
    lower: Sequence[str] = ()
    cast: Mapping[str, str] = field(default_factory=dict)


def transform_records(df: DataFrame, spec: RecordSpec) -> DataFrame:
    """Select, tidy, cast and rename columns. Casts that fail give null."""
    out = []
    for name in spec.select or df.columns:
        c = _quoted(name)
        if name in spec.trim:
            c = strip(c)
        if name in spec.lower:
            c = F.lower(c)
        if name in spec.cast:
            c = c.try_cast(spec.cast[name])
        out.append(c.alias(spec.rename.get(name, name)))
    return df.select(*out)


def merge_sources(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join of a table with side data. Catalyst broadcasts the side only when its size allows."""
    return left.join(right, list(on), how)


def filter_paths(df: DataFrame, prefix: str, extension: str) -> DataFrame:
    """Files (``type`` blob) of a tree whose ``path`` has a prefix and an ending."""
    path = F.col("path")
    return df.where((F.col("type") == "blob") & path.startswith(prefix) & path.endswith(extension))


def count_paths(df: DataFrame, prefix: str, extension: str) -> DataFrame:
    return filter_paths(df, prefix, extension).agg(F.count(F.lit(1)).alias("answer"))
