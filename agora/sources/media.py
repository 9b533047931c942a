"""Media files: listings, images as base64, and a gated metadata probe."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base64_text


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of files below a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def existing(df: DataFrame, files: DataFrame, path: Column) -> DataFrame:
    """df with `found`: whether its file is listed. Paths are compared by their ends, without the scheme."""
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    named = files.select(bare(F.col("path")).alias("__file")).distinct()
    return df.withColumn("__path", bare(path)).join(named, F.col("__path") == F.col("__file"), "left").withColumn("found", F.col("__file").isNotNull()).drop("__path", "__file")


def images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, base64) of image files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", base64_text(F.col("content")).alias("base64"))


def probe(path: Column, reader: Callable[[str], tuple[float, float]]) -> Column:
    """struct<fps, frame_count, duration, error> of video files; `reader` gives rate and count, and 0 frames a second is an error."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for p in s:
                try:
                    fps, n = reader(p)
                    rows.append((fps, n, n / fps, None))
                except Exception as e:
                    rows.append((None, None, None, str(e)[:300]))
            yield pd.DataFrame(rows, columns=["fps", "frame_count", "duration", "error"])

    return F.pandas_udf(run, "fps double, frame_count double, duration double, error string")(path)  # type: ignore[call-overload]
