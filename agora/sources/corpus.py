"""The corpus: CSV exports, Parquet partitioned by language, and CSV exports again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import na_to_null
from ..schemas import PROVENANCE, VIDEOS

CORPUS = T.StructType([*VIDEOS, *PROVENANCE, T.StructField("whisperResult", T.StringType()), T.StructField("language", T.StringType())])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = CORPUS) -> DataFrame:
    """Quoted line breaks and doubled quotes are read; every token that means a missing value becomes null.

    Columns are read as text and cast by name, so that a bad number is null instead of an error.
    """
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return raw.select(*(na_to_null(F.col(f"`{f.name}`")).alias(f.name) if f.dataType == T.StringType() else na_to_null(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in schema))


def read_partitions(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if language is None else df.where(F.col("language") == language)


def usable(df: DataFrame, required: list[str], language: str | None = None) -> DataFrame:
    """Rows that have all required columns, of one language if given."""
    out = df.na.drop(subset=required)
    return out if language is None else out.where(F.col("language") == F.lit(language))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_partitions(df: DataFrame, path: str, by: str = "language") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def export_csv(df: DataFrame, path: str, by: str | None = "language") -> None:
    """CSV with a header; nulls are empty fields, and nested columns are JSON."""
    nested = {c: F.to_json(c) for c, k in df.dtypes if k.startswith(("array", "struct", "map"))}
    flat = df.withColumns(nested)
    flat = flat.select(*(F.col(c) if c == by else F.col(c).cast("string").alias(c) for c in flat.columns))
    writer = flat.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).csv(path, header=True, quote='"', escape='"', emptyValue="")


def create_table(spark: SparkSession, name: str, schema: T.StructType) -> None:
    from ..schemas import ddl

    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl(schema)}) USING parquet")
