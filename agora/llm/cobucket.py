"""Operator 12: two tables rewritten into the same buckets, one sorted file per table and bucket.

A bucket is a CRC-32 of the key. Spark deals rows by another hash, so each target partition gets a surrogate: the
least integer that Spark's own hash deals there. A repartition by the surrogate of a row's bucket then puts each bucket
into a partition of its own, and sorting in partitions and writing are Spark's. Starting files that already hold exactly
one bucket, and all of it, stay where they are; the others are read, dealt anew and, once the new files are committed,
deleted.

Buckets, and so files, surrogates and lists of files, are of a fixed number; everything else stays in tasks. A bucket's
file is written whole, by one task, which sorts with spilling: a key that holds a third of all rows makes one large file.

Rows with a null key go to the last bucket, rows of the right table without a partner to the one before it. Repeated and
broken rows are kept as they are; equal rows always share their files. Extra columns are part of the order, whatever
their names. An empty table has no files and no rows in the result. A lost executor repeats its tasks: where a row goes
depends on the row alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, shared_folder, table
from .lines import free

BUCKETS = 600
#: Folders of starting and of new files below a table's; also the partition columns there, if the table has none so called.
START, FINAL = "start", "bucket"
#: Repetitions of a key that are hashed at a time.
REPEATED = 1 << 16


@dataclass
class Table:
    """A table to be rewritten: its name, rows, and the number (0 to BUCKETS + 1) of the file in which a row starts."""

    name: str
    rows: DataFrame
    number: Column


def surrogates(spark: SparkSession, parts: int) -> list[int]:
    """For each of `parts` partitions the least integer that a repartition by an integer column deals to it."""
    n, found = 8 * parts, {}
    while len(found) < parts:
        n *= 2
        dealt = spark.range(n).select(F.col("id").cast("int").alias("i"))
        least = dealt.groupBy(F.pmod(F.hash("i"), F.lit(parts)).alias("p")).agg(F.min("i").alias("i"))
        found = {r.p: r.i for r in least.collect()}  # a row for each partition
    return [found[p] for p in range(parts)]


def crc_bucket(key: str, buckets: int = BUCKETS, salt: str = "s") -> Column:
    """CRC-32 of the salt and the key in decimal, modulo the number of buckets; buckets + 1 for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.concat(F.lit(salt), F.col(key).cast("string"))), F.lit(buckets)), F.lit(buckets + 1)).cast("int")


def write(rows: DataFrame, number: str, path: str, keys: list[int], key: str) -> None:
    """Writes rows, one file for each value of the column `number` (0 to len(keys) - 1): sorted by key descending, then by the other columns in order, nulls first."""
    rest = [F.col(f"`{c}`").asc_nulls_first() for c in rows.columns if c not in (key, number)]
    dealt = rows.repartition(len(keys), F.element_at(F.lit(keys), F.col(number) + 1))
    ordered = dealt.sortWithinPartitions(number, F.col(key).desc_nulls_first(), *rest)
    ordered.write.partitionBy(number).option("maxRecordsPerFile", 0).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)


class Rewriting:
    """One table on its way from starting files to buckets, below `home`."""

    def __init__(self, t: Table, home: str, keys: list[int], key: str):
        self.t, self.keys, self.key, self.spark = t, keys, key, t.rows.sparkSession
        self.at = {x: f"{home}/{t.name}/{x}" for x in (START, FINAL)}
        self.column = {x: free(x, t.rows.columns) for x in (START, FINAL)}
        write(t.rows.withColumn(self.column[START], t.number.cast("int")), self.column[START], self.at[START], keys, key)

    def read(self, folder: str) -> DataFrame:
        """The rows of the files there, with the number of the file beside them."""
        schema = T.StructType([*self.t.rows.schema, T.StructField(self.column[folder], T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.at[folder])

    def files(self, rows: DataFrame, folder: str) -> dict[int, str]:
        """Number to path of the files that rows are read from: at most one for each number."""
        found = [(int(re.search(rf"/{re.escape(self.column[folder])}=(\d+)/[^/]+$", p)[1]), p) for p in rows.inputFiles()]
        if len(found) != len(dict(found)):
            raise ValueError("a number has several files")
        return dict(found)

    def rewrite(self, partners: DataFrame | None) -> None:
        """Moves the rows of all starting files that are not exactly one bucket. partners: the keys, once each, that a row may have."""
        start, own, key, to = self.read(START), self.column[START], self.key, self.column[FINAL]

        def bucketed(df: DataFrame) -> DataFrame:
            if partners is None:
                return df.withColumn(to, crc_bucket(key, len(self.keys) - 2))
            known = free("known", df.columns)
            # a merge join: no side is ever broadcast, and a hot key is split by adaptive execution
            met = df.join(partners.select(F.col(key), F.lit(True).alias(known)).hint("merge"), key, "left")
            lost = F.col(key).isNotNull() & F.col(known).isNull()
            return met.withColumn(to, F.when(lost, len(self.keys) - 2).otherwise(crc_bucket(key, len(self.keys) - 2))).drop(known)

        counted = start.groupBy(own, key).agg(F.count("*").alias("__n"))  # a key's rows in a file are one row here
        flow = bucketed(counted).groupBy(F.col(own).alias("s"), F.col(to).alias("bucket")).agg(F.sum("__n").alias("n"))
        self.flow = checkpointed(flow)  # files * buckets rows at most
        alone = self.flow.groupBy("s").agg(F.count("*").alias("k"), F.min("bucket").alias("bucket")).where("k = 1").drop("k")
        whole = self.flow.groupBy("bucket").agg(F.count("*").alias("k")).where("k = 1").drop("k")
        self.stays = {r.s: r.bucket for r in alone.join(whole, "bucket").collect()}  # a row for each starting file at most
        moving = start.where(~F.col(own).isin(*self.stays)) if self.stays else start
        write(bucketed(moving).select(*(f"`{c}`" for c in self.t.rows.columns), to), to, self.at[FINAL], self.keys, key)
        self.moved = self.read(FINAL)
        old, new = self.files(start, START), self.files(self.moved, FINAL)
        self._delete([p for n, p in old.items() if n not in self.stays])
        self.final = [(self.t.name, b, p, True) for b, p in new.items()] + [(self.t.name, b, old[n], False) for n, b in self.stays.items()]

    def _delete(self, paths: list[str]) -> None:
        """Deletes starting files and their folders; all at once where none stays."""
        jvm = self.spark._jvm
        path, uri, fs = jvm.org.apache.hadoop.fs.Path, jvm.java.net.URI, jvm.org.apache.hadoop.fs.Path(self.at[START]).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for at in [path(uri(p)).getParent() for p in paths] if self.stays else [path(self.at[START])]:
            fs.delete(at, True)

    def columns(self) -> str:
        """The columns that a final file has."""
        return ",".join(self.spark.read.parquet(self.final[0][2]).columns) if self.final else ""

    def runs(self) -> DataFrame:
        """(table_name, bucket, id, n, first, last): how often a key occurs in a final file, and its first and last row there."""
        parts = [self.moved.withColumn("__b", F.col(self.column[FINAL]))]
        if self.stays:
            place = [self.stays.get(n, -1) for n in range(len(self.keys))]
            parts.append(self.read(START).withColumn("__b", F.element_at(F.lit(place), F.col(self.column[START]) + 1)))
        parts = [x.select(F.col("__b").alias("bucket"), F.col(self.key).alias("id"), F.col("_metadata.row_index").alias("at")) for x in parts]
        seen = reduce(DataFrame.unionAll, parts).groupBy("bucket", "id").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
        return seen.select(F.lit(self.t.name).alias("table_name"), "*")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file: its rows, and the SHA-256 of its keys in file order. Runs of equal keys come sorted by file and place."""
    now, rows, sha = None, 0, hashlib.sha256()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"table_name": now[0], "bucket": now[1], "n_rows": rows, "ids_sha256": sha.hexdigest()}], schema=pa.schema([("table_name", pa.string()), ("bucket", pa.int32()), ("n_rows", pa.int64()), ("ids_sha256", pa.string())]))

    for b in batches:
        for name, bucket, key, n, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (name, bucket) != now:
                if now:
                    yield told()
                now, rows, sha = (name, bucket), 0, hashlib.sha256()
            if first != rows or last - first + 1 != n:
                raise ValueError("a file is not sorted by its key")
            text = b"" if key is None else b"%d" % key
            if not rows:
                sha.update(text)
            left = n - (not rows)
            while left:
                k = min(left, REPEATED)
                sha.update((b"," + text) * k)
                left -= k
            rows += n
    if now:
        yield told()


def cobucket(left: Table, right: Table, key: str, home: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes both tables below `home` in starting files, rewrites them into buckets of the key, and returns a row per final file.

    table_name, bucket, path, columns, n_rows, ids_sha256 (the file's keys in its order), lineage_sha256 (its rows by
    starting file), n_joined (rows of the bucket's inner join on the key), rewritten (false: a starting file that stayed).
    Each table is afterwards all Parquet files below home/name (option recursiveFileLookup).
    """
    spark = left.rows.sparkSession
    keys = surrogates(spark, buckets + 2)
    both = [Rewriting(t, home, keys, key) for t in (left, right)]
    both[0].rewrite(None)
    both[1].rewrite(left.rows.where(F.col(key).isNotNull()).select(key).distinct())
    runs = checkpointed(both[0].runs().unionAll(both[1].runs()))
    dealt = runs.repartition(buckets + 2, F.element_at(F.lit(keys), F.col("bucket") + 1)).sortWithinPartitions("table_name", "bucket", "first")
    digests = dealt.select("table_name", "bucket", "id", "n", "first", "last").mapInArrow(_digested, "table_name string, bucket int, n_rows long, ids_sha256 string")
    one, two = (runs.where(F.col("table_name") == t.name).select("bucket", "id", F.col("n").alias(x)) for t, x in ((left, "a"), (right, "b")))
    joined = one.join(two.hint("merge"), ["bucket", "id"]).groupBy("bucket").agg(F.sum(F.col("a") * F.col("b")).alias("n_joined"))
    flows = [r.flow.select(F.lit(r.t.name).alias("table_name"), "*") for r in both]
    origin = F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda x: F.concat_ws(":", x["s"], x["n"]))  # at most one for each starting file
    origins = flows[0].unionAll(flows[1]).groupBy("table_name", "bucket").agg(F.sha2(F.array_join(origin, ","), 256).alias("lineage_sha256"))
    listed = [(*f, names) for r in both for names in [r.columns()] for f in r.final]
    final = spark.createDataFrame(listed, "table_name string, bucket int, path string, rewritten boolean, columns string")
    out = final.join(digests, ["table_name", "bucket"]).join(origins, ["table_name", "bucket"]).join(joined, "bucket", "left")
    return out.select("table_name", F.col("bucket").cast("long").alias("bucket"), "path", "columns", "n_rows", F.coalesce("n_joined", F.lit(0)).alias("n_joined"), "ids_sha256", "lineage_sha256", "rewritten")


def op12_cobucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = crc_bucket("sale_id")
    item = F.pmod(F.crc32(F.col("item_id").cast("string")), F.lit(BUCKETS))
    sales = Table("sales", table(spark, sf_dir, "sales"), F.when(b % 4 == 1, b - 1).otherwise(b))
    lines = Table("sale_lines", table(spark, sf_dir, "sale_lines"), F.coalesce(item, F.lit(0)))
    return cobucket(sales, lines, "sale_id", f"{shared_folder(spark)}/cobucket-{uuid.uuid4().hex}")
