"""Colours and differences of images in the layout of Spark's image source.

An image is the struct ``origin, height, width, nChannels, mode, data`` with
bytes in blue, green, red (alpha) order, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images below a path, one row each; files that are no image are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def _pixels(data: bytes, channels: int) -> np.ndarray:
    """Colours as numbers 0xRRGGBB in row-major order; alpha is not looked at."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, channels).astype(np.int64)
    if channels < 3:
        return raw[:, 0] * 0x010101
    return raw[:, 2] * 0x10000 + raw[:, 1] * 0x100 + raw[:, 0]


def color_counts(images: DataFrame, key: str = "origin") -> DataFrame:
    """``(key, rgb, n, first_at)``: every colour of every image, how often and where first."""
    schema = T.StructType(
        [
            T.StructField(key, images.schema[key].dataType),
            T.StructField("rgb", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("first_at", T.LongType()),
        ]
    )

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, channels, data in zip(part[key], part["nChannels"], part["data"]):
                colors, first, n = np.unique(_pixels(data, int(channels)), return_index=True, return_counts=True)
                yield pd.DataFrame({key: name, "rgb": colors, "n": n, "first_at": first})

    return images.select(key, "nChannels", "data").mapInPandas(count, schema)


def dominant_colors(images: DataFrame, key: str = "origin") -> DataFrame:
    """The most frequent colour of each image as ``#rrggbb``; of equal ones the first to appear. One row per image leaves a task."""
    schema = T.StructType([T.StructField(key, images.schema[key].dataType), T.StructField("color", T.StringType())])

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for channels, data in zip(part["nChannels"], part["data"]):
                colors, first, n = np.unique(_pixels(data, int(channels)), return_index=True, return_counts=True)
                found.append(f"#{int(colors[np.lexsort((first, -n))[0]]):06x}" if len(colors) else None)
            yield pd.DataFrame({key: part[key], "color": found})

    return images.select(key, "nChannels", "data").mapInPandas(best, schema)


@F.pandas_udf(T.LongType())
def _differing(a: pd.Series, a_channels: pd.Series, b: pd.Series, b_channels: pd.Series) -> pd.Series:
    counts = [
        int((_pixels(x, int(m)) != _pixels(y, int(n))).sum())
        for x, m, y, n in zip(a, a_channels, b, b_channels)
    ]
    return pd.Series(counts, dtype="int64")


def pixel_diff(images: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """``(key, differing)``: pixels that differ between images of the same key; null when sizes differ."""
    fields = ("height", "width", "nChannels", "data")
    a = images.select(key, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = others.select(key, *[F.col(f).alias(f"b_{f}") for f in fields])
    pairs = a.join(b, key)
    same_size: Column = (F.col("a_height") == F.col("b_height")) & (F.col("a_width") == F.col("b_width"))
    same = pairs.where(same_size).select(
        key, _differing("a_data", "a_nChannels", "b_data", "b_nChannels").alias("differing")
    )
    other = pairs.where(~same_size).select(key, F.lit(None).cast("bigint").alias("differing"))
    return same.unionByName(other)
