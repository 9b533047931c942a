"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What Python gets of a partition at once where texts or images are as long as they like; Spark's own limit is a number of rows.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; in local mode, where every task sees the same disk, a new folder if that is unset."""
    if (shared := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return shared
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="agora-shared-")
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str = "step") -> DataFrame:
    """df, computed once and read back from the shared folder: later uses and lost executors do not compute it again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside goes to Python in batches of so many bytes, whatever the length of its rows; a row is never cut. The session's own setting comes back."""
    before = spark.conf.get(BATCH[0], None)
    spark.conf.set(*BATCH)
    try:
        yield
    finally:
        spark.conf.unset(BATCH[0]) if before is None else spark.conf.set(BATCH[0], before)
