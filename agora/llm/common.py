"""Helpers that the training-data operators share: table access, checkpoints, and vectorised word hashing.

Word hashing works on the UTF-8 bytes of an Arrow string column, so no Python
string is made for a word. A word is a maximal run of bytes that are not
separators; its 64-bit hash is a polynomial over random byte values, taken from
one running sum per block of text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at a time; working arrays take about 60 times as much.
BLOCK = 1 << 19
#: Short rows (some numbers each) that one task of a loop holds.
LOOP_ROWS = 1 << 18

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the driver and all executors share."""
    if (shared := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return shared
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="agora-shared-")
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def shared_file(spark: SparkSession, prefix: str, blob: pa.Buffer) -> str:
    """The name by which tasks find, on their own disk, a file of these bytes; it goes out through the shared folder."""
    name = f"{prefix}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(at)
    for i in range(0, blob.size, 1 << 20):
        out.write(blob[i : i + (1 << 20)].to_pybytes())
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(at).toString())
    return name


def checkpointed(df: DataFrame, forget: bool = False) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the cluster's spark.checkpoint.dir. Only in local mode, where every task sees the same disk, is one made if that is unset.
    With forget, the result has not the estimated size of the plan that made it: a join's is the product of its sides', so that
    in a loop of joins the estimate would double its digits in every step. Adaptive execution goes by real sizes.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    kept, spark = df.checkpoint(), df.sparkSession
    if not forget:
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def few(rows: int, spark: SparkSession) -> int:
    """Partitions for so many short rows of a loop: each step of one costs a file per task, so a small table goes into few."""
    return max(1, min(shuffle_partitions(spark), -(-rows // LOOP_ROWS)))


def smallest(df: DataFrame, at: str, tie: str, rows: int) -> DataFrame:
    """At most `rows` rows, those of the smallest 64-bit hash `at`.

    Of many rows, those whose hash is clearly too large go first, so that tasks do not each send `rows` of them.
    """
    n = df.count()
    if n > 2 * rows:
        df = df.where(F.col(at) < int(2**64 * 1.1 * rows / n) - 2**63)
    return df.orderBy(at, tie).limit(rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def separators(extra: bytes = b"") -> np.ndarray:
    """A lookup table of the bytes that end a word: space, 0x09-0x0D, and extra."""
    lut = np.zeros(256, bool)
    lut[[0x20, *range(0x09, 0x0E), *extra]] = True
    return lut


SPACE = separators()
#: ASCII characters that are neither letters nor digits also separate.
NOT_ALNUM = separators(bytes(c for c in range(128) if not chr(c).isalnum()))


def byte_values(fold: bool) -> np.ndarray:
    """The random value of each byte; with fold, A-Z have those of a-z."""
    v = _BYTE.copy()
    if fold:
        v[65:91] = v[97:123]
    return v


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd multiplier and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, inverse = max(n, BLOCK + 1), pow(_MULT, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, m, np.uint64))), dtype=np.uint64) for m in (_MULT, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """sums[e] - sums[s], times inverse power s, is the polynomial hash of data[s:e]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0], out=sums[1:])
    return sums


def column(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    arr = (arr.fill_null("") if arr.null_count else arr).cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, offsets: np.ndarray, seps: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Blocks of about BLOCK bytes as (first document, last + 1, begin, end). A longer text comes in several, cut before separators."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        begin, end = int(offsets[i]), int(offsets[j])
        while j == i + 1 and end - begin > BLOCK:
            cut = begin + BLOCK
            while cut < end and not seps[data[cut]]:
                cut += 1
            if cut >= end:
                break
            yield i, j, begin, cut
            begin = cut
        yield i, j, begin, end
        i = j


def words(data: np.ndarray, begin: int, end: int, starts_of: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, from begin on, of the words of data[begin:end]; documents start at starts_of."""
    part = data[begin:end]
    inside = ~seps[part]
    first = np.empty(len(part), bool)
    first[:1] = True
    np.logical_not(inside[:-1], out=first[1:])
    marks = starts_of[(starts_of > begin) & (starts_of < end)] - begin
    first[marks] = True
    last = np.empty(len(part), bool)
    last[-1:] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[marks - 1] = True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, seps: np.ndarray = SPACE, fold: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, offsets of each document's words, hashes of the words) for runs of whole documents."""
    values, held = byte_values(fold), []
    for i, j, begin, end in pieces(data, offsets, seps):
        s, e = words(data, begin, end, offsets[i : j + 1], seps)
        sums = prefix_sums(data[begin:end], values)
        h = mix((sums[e] - sums[s]) * powers(len(sums))[1][s])
        if j == i + 1 and end < offsets[j]:
            held.append(h)
            continue
        if held:
            h, held = np.concatenate([*held, h]), []
            yield i, np.array([0, len(h)]), h
            continue
        yield i, np.concatenate(([0], np.searchsorted(s, offsets[i + 1 : j + 1] - begin))), h


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words."""
    if len(h) < k:
        return h[:0]
    out = np.zeros(len(h) - k + 1, np.uint64)
    for x in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[x : x + len(out)]
    return mix(out)
