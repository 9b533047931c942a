"""The landing zone: API responses and posted records, as JSON lines that batch and streaming read alike."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cache
from ..schemas import PROVENANCE

RESPONSES = T.StructType([T.StructField("request_url", T.StringType()), T.StructField("body", T.StringType()), T.StructField("received_at", T.TimestampType()), *PROVENANCE])
RESPONSES_OWN = [f.name for f in RESPONSES if f.name != "body"]
RECORDS = T.StructType([T.StructField("endpoint", T.StringType()), T.StructField("body", T.StringType()), T.StructField("received_at", T.TimestampType())])


def read(spark: SparkSession, path: str, schema: T.StructType = RESPONSES) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream(spark: SparkSession, path: str, schema: T.StructType = RESPONSES, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def with_provenance(responses: DataFrame, country: str, kind: str, item: str, url: str) -> DataFrame:
    """Where and how responses were collected, as columns of each."""
    return responses.withColumns({"scrapedCountry": F.lit(country), "scrapedType": F.lit(kind), "scrapedItem": F.lit(item), "scrapedUrl": F.lit(url)})


#: Pieces of responses as an interception delivers them: `chunk` of `chunks`, from 0 on, bytes in base64. They may come in any order and more than once.
CHUNKS = T.StructType([T.StructField("response_id", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("chunks", T.IntegerType()), T.StructField("data", T.StringType()), *(f for f in RESPONSES if f.name != "body")])


def _body(parts: Column) -> Column:
    """The text of pieces in order: bytes are joined before they are read as UTF-8, for a character may be cut; what is no UTF-8 is replaced."""
    raw = F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(F.try_to_binary(x["data"], F.lit("base64")))), ""))
    return F.make_valid_utf8(raw.cast("string"))


def assembled(chunks: DataFrame) -> DataFrame:
    """Each response of which all pieces are there, once: response_id and the columns of RESPONSES, of the piece that came first.

    Of a piece that comes twice the first counts. Pieces without an id, a number or a number of pieces are left out, and so are those that are out of range.
    """
    good = chunks.where("response_id is not null and chunk >= 0 and chunk < chunks")
    order = F.struct("received_at", "data")
    once = good.groupBy("response_id", "chunk").agg(F.min_by(F.struct("chunks", "data", *RESPONSES_OWN), order).alias("c")).select("response_id", "chunk", "c.*")
    whole = once.groupBy("response_id").agg(F.max("chunks").alias("chunks"), F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("parts"), F.min_by(F.struct(*RESPONSES_OWN), F.struct("received_at", "chunk")).alias("r"))  # a response's own pieces
    return whole.where(F.size("parts") == F.col("chunks")).select("response_id", "r.request_url", _body(F.col("parts")).alias("body"), *(f"r.{c}" for c in RESPONSES_OWN if c != "request_url"))


def post(df: DataFrame, url: str, keys: tuple[str, ...], timeout: float = 30) -> DataFrame:
    """Posts every row as JSON: (keys..., ok, status, error). Failures are reported, not raised.

    Each request carries a key made of the row's own keys, by which a server can tell a repetition.
    """
    rows = df.select(*keys, F.sha2(F.to_json(F.struct(*keys)), 256).alias("once"), F.to_json(F.struct("*")).alias("body"))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for b in batches:
            out = []
            for once, body in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True):
                request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", "Idempotency-Key": once})
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as reply:
                        out.append((True, reply.status, None))
                except urllib.error.HTTPError as e:
                    out.append((False, e.code, str(e)[:300]))
                except OSError as e:
                    out.append((False, None, str(e)[:300]))
            ok, status, error = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(ok, pa.bool_()), pa.array(status, pa.int32()), pa.array(error, pa.string())], names=[*keys, "ok", "status", "error"])

    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "ok boolean, status int, error string"]))


def post_once(df: DataFrame, url: str, path: str, keys: tuple[str, ...]) -> DataFrame:
    """Posts the rows whose key the table at `path` has not as posted, and returns that table: (keys..., ok, status, error).

    What a server has refused is tried again by the next call. A call that ends before its results are committed leaves
    its rows to be posted again, under the same keys of repetition.
    """
    schema = ", ".join([*(f"{k} string" for k in keys), "ok boolean, status int, error string"])
    return cache.with_stage_cache(df.dropDuplicates(list(keys)), path, keys, lambda rows: post(rows, url, keys), schema)
