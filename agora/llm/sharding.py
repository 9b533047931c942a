"""Operator 9: shards of equal bytes by Karmarkar-Karp differencing.

Rows with equal texts form one indivisible group. Groups are dealt into blocks by the hash of their text, about
BLOCK_GROUPS each, and every block runs the differencing method by itself: each group is a partial partition with all
its bytes in one shard; the two partial partitions of largest spread are
combined, the fullest shards of one with the emptiest of the other, until one is
left. The blocks' results are partial partitions as well: FAN of them at a time are combined in the same way, level by
level, until one is left. So every step runs on executors with a bounded number of partial partitions, and
shards depend on the texts alone, not on the order in which they arrive.

Null texts count as empty. Repeated ids, ties and extra columns are allowed; an
empty table gives an empty result. One group larger than a fair share makes
equal sizes impossible, and then gets a shard almost to itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Groups that a block holds, on average, and partial partitions that are combined at a time on the levels above.
BLOCK_GROUPS, FAN = 50_000, 256


def differencing(loads: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Combines partial partitions (each a list of k loads) into one.

    Returns for each of them the final place of each of its k shards, and the final loads.
    """
    k, n = len(loads[0]), len(loads)
    heap, made = [], []
    order0 = []
    for i, load in enumerate(loads):
        order = sorted(range(k), key=lambda x: -load[x])
        order0.append(order)
        heap.append((load[order[-1]] - load[order[0]], i, [load[x] for x in order], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        b.reverse()
        c = [p + q for p, q in zip(a, b, strict=True)]
        order = sorted(range(k), key=c.__getitem__, reverse=True)
        c = [c[p] for p in order]
        made.append((x, y, order))
        heapq.heappush(heap, (c[-1] - c[0], n + len(made), c, n + len(made) - 1))
    place = np.zeros((n + len(made), k), np.int64)  # of the shards of a node, in its own order
    place[heap[0][3]] = np.arange(k)
    for at in range(len(made) - 1, -1, -1):
        x, y, order = made[at]
        back = np.empty(k, np.int64)
        back[order] = place[n + at]
        place[x], place[y] = back, back[::-1]
    out = np.empty((n, k), np.int64)
    np.put_along_axis(out, np.array(order0), place[:n], 1)
    return out, heap[0][2]


LOADS = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("place", pa.int32()), ("loads", pa.list_(pa.int64()))])
LOADS_DDL = "block long, key long, size long, crc long, place int, loads array<long>"
STEP = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("above", pa.int64()), ("to", pa.int32()), ("loads", pa.list_(pa.int64()))])
STEP_DDL = "block long, place int, above long, to int, loads array<long>"


def _solved(shards: int):
    """The place of each group of a block, and one row with the loads of the places."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("bytes", "descending"), ("key", "ascending"), ("size", "ascending"), ("crc", "ascending")])
        n, zeros = t.num_rows, [0] * (shards - 1)
        places, loads = differencing([[w, *zeros] for w in t["bytes"].to_pylist()])
        block = pa.array([key[0].as_py()] * n, pa.int64())
        of = pa.Table.from_arrays([block, t["key"], t["size"], t["crc"], pa.array(places[:, 0].astype(np.int32)), pa.nulls(n, pa.list_(pa.int64()))], schema=LOADS)
        return pa.concat_tables([of, pa.Table.from_pylist([{"block": key[0].as_py(), "loads": loads}], schema=LOADS)])

    return run


def _combined(key: tuple, t: pa.Table) -> pa.Table:
    """Where the places of some blocks go in the one above them, and one row with its loads."""
    t = t.sort_by("block")
    places, loads = differencing(t["loads"].to_pylist())
    above = key[0].as_py()
    rows = [{"block": b, "place": p, "above": above, "to": to} for b, row in zip(t["block"].to_pylist(), places.tolist(), strict=True) for p, to in enumerate(row)]
    return pa.Table.from_pylist([*rows, {"above": above, "loads": loads}], schema=STEP)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's number among the rows of its shard in this partition."""
    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        shard = b.column(b.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
        at = np.empty(len(shard), np.int64)
        for s in np.unique(shard).tolist():
            rows = np.flatnonzero(shard == s)
            at[rows] = seen.get(s, 0) + np.arange(len(rows))
            seen[s] = seen.get(s, 0) + len(rows)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(at)], names=[*b.schema.names, "part", "nth"])


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard (0 to shards - 1, bytes near equal, equal texts together) and slot (gapless in the shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("key")))
    groups = checkpointed(rows.groupBy("key", "size", "crc").agg((F.count("*") * F.col("size")).alias("bytes")))
    blocks = max(1, -(-groups.count() // BLOCK_GROUPS))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    solved = checkpointed(dealt.groupBy("block").applyInArrow(_solved(shards), LOADS_DDL))
    of = solved.where("loads is null").select("key", "size", "crc", "block", "place")
    loads = solved.where("loads is not null").select("block", "loads")
    while blocks > 1:
        blocks = -(-blocks // FAN)
        step = checkpointed(loads.groupBy(F.expr(f"block div {FAN}").alias("above")).applyInArrow(_combined, STEP_DDL))
        of = of.join(step.where("loads is null").select("block", "place", "above", "to"), ["block", "place"]).select("key", "size", "crc", F.col("above").alias("block"), F.col("to").alias("place"))
        loads = step.where("loads is not null").select(F.col("above").alias("block"), "loads")
    of = of.select("key", "size", "crc", F.col("place").alias("shard"))
    numbered = checkpointed(rows.join(of, ["key", "size", "crc"]).select("id", "size", "crc", "shard").mapInArrow(_numbered, f"id {dict(rows.dtypes)['id']}, size long, crc long, shard int, part int, nth long"))
    held = numbered.groupBy("part", "shard").agg(F.count("*").alias("n"))  # one row per partition and shard
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = held.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return numbered.join(begin, ["part", "shard"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("begin") + F.col("nth")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
