"""Stage caches: what has been processed is looked up, and only the rest is processed and appended."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

KEYS = ("author_username", "video_id")


def keyed(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys as text, as caches have them."""
    return df.withColumns({k: F.col(k).cast("string") for k in keys})


def first_hit(cache: DataFrame, keys: tuple[str, ...] = KEYS, order: str | None = None) -> DataFrame:
    """One row per key: the first by `order`, or any if rows of a key are equal."""
    if order is None:
        return keyed(cache, keys).dropDuplicates(list(keys))
    w = Window.partitionBy(*keys).orderBy(order)
    return keyed(cache, keys).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def hits(df: DataFrame, cache: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return keyed(df, keys).join(keyed(cache, keys), list(keys), "left_semi")


def todo(df: DataFrame, cache: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return keyed(df, keys).join(keyed(cache, keys), list(keys), "left_anti")


def lookup(df: DataFrame, cache: DataFrame, keys: tuple[str, ...] = KEYS, order: str | None = None) -> DataFrame:
    """Left join with the first cached row of each key."""
    return keyed(df, keys).join(first_hit(cache, keys, order), list(keys), "left")


def updated(df: DataFrame, stage: DataFrame, keys: tuple[str, ...], columns: list[str]) -> DataFrame:
    """df with columns from the stage where it has a value, else its own."""
    new = stage.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    have = [c for c in columns if c in df.columns]
    out = df.join(new, list(keys), "left")
    out = out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in have else F.col(f"__{c}") for c in columns})
    return out.drop(*(f"__{c}" for c in columns))


def with_empty(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Null columns of the given types for those that are missing."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A stage table; empty if nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # Spark has no call that asks any file system whether a path exists
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


#: What a stage table's manifest has of each run: its counts, the runs that it stands in for, and a Bloom filter of its accepted keys.
MANIFEST = "run string, committed_at timestamp, n_ok long, n_errors long, replaces array<string>, log_bits int, bloom binary"
#: Hash functions of a filter, bits for each key, the largest filter (1 MiB), and the most filters that are asked. Past these rows are joined only.
HASHES, KEY_BITS, MAX_LOG_BITS, MAX_FILTERS = 4, 10, 23, 32


def committed(spark: SparkSession, path: str) -> list[Row]:
    """The runs whose rows count: a row for each that the manifest has and that no other run there stands in for."""
    runs = read(spark, f"{path}/manifest", MANIFEST).collect()
    gone = {x for r in runs for x in r.replaces or []}
    return [r for r in runs if r.run not in gone]


def _rows(spark: SparkSession, path: str, schema: str, runs: list[Row]) -> DataFrame:
    """All rows of the runs, failed ones included."""
    full = f"{schema}, logged_at timestamp"
    return spark.read.schema(full).parquet(*(f"{path}/run-{r.run}" for r in runs)) if runs else spark.createDataFrame([], full)


def _hashes(keys: tuple[str, ...]) -> list[Column]:
    return [F.xxhash64(*keys, F.lit(k)) for k in range(HASHES)]


def bloom(rows: DataFrame, keys: tuple[str, ...], n: int) -> tuple[int, bytes | None]:
    """(log2 of its bits, the filter) of n keys; None where it would be larger than MAX_LOG_BITS. It is made of 64-bit words, by key of the word."""
    log_bits = max(6, (KEY_BITS * max(n, 1) - 1).bit_length())
    if log_bits > MAX_LOG_BITS:
        return log_bits, None
    mask = F.lit((1 << log_bits) - 1).cast("long")
    at = rows.select(F.explode(F.array(*(h.bitwiseAND(mask) for h in _hashes(keys)))).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("bits")).toPandas()  # 2 ** MAX_LOG_BITS / 64 rows at most
    out = np.zeros((1 << log_bits) // 64, "<i8")
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return log_bits, out.tobytes()


def _maybe(spark: SparkSession, keys: tuple[str, ...], runs: list[Row]) -> Column:
    """False where no run's filter has the key."""
    filters = spark.sparkContext.broadcast([(r.log_bits, r.bloom) for r in runs])  # MAX_FILTERS of 1 MiB at most

    @F.pandas_udf("boolean")
    def probe(*hashes: pd.Series) -> pd.Series:
        hit = np.zeros(len(hashes[0]), bool)
        for log_bits, words in filters.value:
            bits, one = np.frombuffer(words, np.uint8), np.ones(len(hit), bool)
            for h in hashes:
                at = h.to_numpy(np.int64) & ((1 << log_bits) - 1)
                one &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            hit |= one
        return pd.Series(hit)

    return probe(*_hashes(keys))


def unseen(df: DataFrame, path: str, keys: tuple[str, ...], schema: str, runs: list[Row]) -> DataFrame:
    """Rows whose key no run has accepted. Where every run has a filter, only rows that a filter may know are joined."""
    rows, spark = keyed(df, keys), df.sparkSession
    done = _rows(spark, path, schema, runs).where("ok").select(*keys)
    if not runs or len(runs) > MAX_FILTERS or any(r.bloom is None for r in runs):
        return todo(rows, done, keys)
    rows = rows.withColumn("__maybe", _maybe(spark, keys, runs))
    return rows.where(~F.col("__maybe")).unionByName(todo(rows.where("__maybe"), done, keys).select(*rows.columns)).drop("__maybe")


def commit(spark: SparkSession, path: str, run: str, keys: tuple[str, ...], schema: str, replaces: list[str] | None = None) -> None:
    """Makes the rows of a run count, accepted and failed ones at once: the manifest gets one file of one row. A run without rows is left out."""
    rows = spark.read.schema(f"{schema}, logged_at timestamp").parquet(f"{path}/run-{run}")
    n = rows.agg(F.count("*").alias("n"), F.count_if("ok").alias("ok")).first()
    if not n.n and not replaces:
        return
    log_bits, made = bloom(rows.where("ok").select(*keys), keys, n.ok)
    row = (run, datetime.now(UTC), n.ok, n.n - n.ok, replaces, log_bits, made)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def with_stage_cache(df: DataFrame, path: str, keys: tuple[str, ...], stage: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Runs the stage over what the table at `path` lacks, adds its results, and returns all accepted rows of the table.

    The stage maps rows with the keys to (keys..., ok, ...). Its results are written once, to a folder of the run, and count from the moment
    in which the manifest names the run: a run that ends before leaves nothing, and the next one asks its rows again. Rows that are not ok
    are the errors table, with the time; the next run tries them again. Filters and the anti-join come before the stage, so a model sees
    each row at most once per run (a task that is lost and repeated asks its own rows again). Rows with a null key are never known.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    runs = committed(spark, path)
    fresh = stage(unseen(df, path, keys, schema, runs)).select(*T.StructType.fromDDL(schema).names).withColumn("logged_at", F.current_timestamp())
    with small_batches(spark):
        fresh.write.parquet(f"{path}/run-{run}")
    commit(spark, path, run, keys, schema)
    return stage_table(spark, path, schema)


def stage_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The accepted rows of the stage whose table is at `path`; empty if no run is committed."""
    return _rows(spark, path, schema, committed(spark, path)).where("ok").drop("logged_at")


def errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What has failed in the stage whose table is at `path`: (its columns, logged_at)."""
    return _rows(spark, path, schema, committed(spark, path)).where(~F.coalesce("ok", F.lit(False)))


def compact(spark: SparkSession, path: str, keys: tuple[str, ...], schema: str) -> None:
    """One run in place of all committed ones, from one moment to the next; the folders that it stands in for are no longer read."""
    runs, run = committed(spark, path), uuid.uuid4().hex
    if len(runs) > 1:
        _rows(spark, path, schema, runs).write.parquet(f"{path}/run-{run}")
        commit(spark, path, run, keys, schema, [r.run for r in runs])
