"""Undoing layers of encoding on a text column."""

from __future__ import annotations

import html
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom import fixed_values as V


@F.pandas_udf(T.StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """HTML entities to characters. Spark has no function for the entity table."""
    return text.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


_COMPLETE = "^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)"
# All but A-Za-z0-9+/= as ranges: Java's negated class takes about ten times as long where eight cores use it at once.
_FOREIGN = r"[\x00-*,-.:-<>-@\[-`{-\x{10FFFF}]++"
_HEAD = 1024


def _peel_base64(df: DataFrame, column: str) -> DataFrame:
    """Adds ``__text`` and ``__layers`` after up to five base64 layers, each a step of plain columns.

    Characters outside the alphabet do not count; what is left must have complete padding, and what
    follows complete padding is not read. A text whose beginning already decodes to bytes that no UTF-8
    text starts with is not decoded whole: it cannot be UTF-8 either. (A character may be cut at the end of the
    beginning, so up to three bytes are let off.)
    """
    now, kept, head, start = F.col("__text"), F.col("__kept"), F.col("__head"), F.col("__start")
    cuts = [F.substring(start, F.lit(1), F.octet_length(start) - n) for n in range(4)]
    may_be = head.contains("=") | reduce(or_, [F.is_valid_utf8(part.cast("string")) for part in cuts])
    bare = F.replace(kept, F.lit("="), F.lit(""))
    whole = F.col("__whole")
    padded = F.when(whole != "", whole).when(F.length(bare) % 4 == 0, bare)
    body = F.when(~kept.contains("="), F.when(F.length(kept) % 4 == 0, kept)).otherwise(padded)
    df = df.withColumns({"__text": F.col(column), "__layers": F.lit(0), "__going": F.lit(True)})
    for _ in range(V.BASE64_LAYERS):
        df = df.withColumn("__head", F.when(F.col("__going"), F.regexp_replace(F.substring(now, 1, _HEAD), _FOREIGN, "")))
        df = df.withColumn("__start", F.try_to_binary(F.substring(head, F.lit(1), F.length(head) - F.length(head) % 4), F.lit("base64")))
        df = df.withColumn("__kept", F.when(may_be, F.regexp_replace(now, _FOREIGN, "")))
        df = df.withColumn("__whole", F.when(kept.contains("="), F.regexp_extract(kept, _COMPLETE, 0)))
        df = df.withColumn("__inner", F.try_validate_utf8(F.try_to_binary(body, F.lit("base64")).cast("string")))
        df = df.withColumn("__going", F.coalesce((F.col("__inner") != "") & (F.col("__inner") != now), F.lit(False)))
        df = df.withColumns({"__text": F.when(F.col("__going"), F.col("__inner")).otherwise(now), "__layers": F.col("__layers") + F.col("__going").cast("int")})
    return df


def _unquoted(text: Column) -> Column:
    """URL escapes to characters; a plus sign and a stray percent sign stand for themselves."""
    guarded = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(guarded), text)).otherwise(text)


def decode_layers(df: DataFrame, column: str) -> DataFrame:
    """Adds ``text`` and ``layers``: base64 layers undone, then URL escapes, then entities."""
    peeled = _peel_base64(df, column).withColumn("__text", _unquoted(F.col("__text")))
    return peeled.select(*df.columns, unescape_entities(F.col("__text")).alias("text"), F.col("__layers").alias("layers"))
