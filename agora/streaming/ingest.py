"""Streaming ingest: the first record of a key wins, whatever the size of the table.

Each table is a query of its own. The keys that have been seen are keyed state (RocksDB), so a micro-batch reads its own
rows and their keys' state only; the target is never read. The file sink commits each batch once, so a restart from the
checkpoint neither repeats nor loses a row. Rows with a null key never conflict and all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.ingest import KEYS, arrivals, insert
from ..sources.landing import CHUNKS, post_once
from ..sources.landing import assembled as landed
from .state import with_store

class FirstRecord(StatefulProcessor):
    """Lets the first row of a key pass, by arrival and then by its text; the key is remembered, for `ttl_ms` if that is given."""

    def __init__(self, order: str, ttl_ms: int | None = None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("yes", T.BooleanType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        best = None
        for r in rows:
            rank = (r[self.order] is None, r[self.order], str(r))
            if best is None or rank < best[0]:
                best = (rank, r)
        self.seen.update((True,))
        yield best[1]

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_records(rows: DataFrame, key: str, order: str = "received_at", known: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """A stream of the first row of each key, and of all rows without a key. known: a table whose keys count as seen from the start.

    With ttl_ms a key is forgotten after that time; such a stream needs a processing-time trigger, for Spark plans batches for its clock without end.
    """
    seen = known.where(F.col(key).isNotNull()).select(key).distinct().groupBy(key) if known is not None else None
    first = with_store(rows).where(F.col(key).isNotNull()).groupBy(key).transformWithState(FirstRecord(order, ttl_ms), rows.schema, "append", "processingTime" if ttl_ms else "none", seen)
    return first.unionAll(rows.where(F.col(key).isNull()))


def start(root: str, checkpoint: str, responses: DataFrame | None = None, records: DataFrame | None = None, names: tuple[str, ...] = tuple(KEYS), every: str | None = None, known: dict[str, DataFrame] | None = None) -> list[StreamingQuery]:
    """Queries over streams of responses, of posted records or of both: one for each table and one for dead letters. Without `every` they take what is there and end."""
    tables, dead = arrivals(responses, records)
    streams = {n: first_records(tables[n], KEYS[n], known=(known or {}).get(n)) for n in names} | {"dead": dead}
    out = []
    for name, rows in streams.items():
        writer = rows.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{checkpoint}/{name}")
        out.append((writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start())
    return out


def upsert(batch: DataFrame, root: str, number: int = 0) -> None:
    """Adds one batch of responses to the tables below root as `insert` does, and malformed ones to `dead`."""
    batch = batch.persist()
    tables, dead = arrivals(batch)
    insert(tables, root, number)
    dead.write.mode("overwrite").parquet(f"{root}/dead/batch={number}")
    batch.unpersist()


#: What is kept of a piece beside its key.
PIECE = [name for name in CHUNKS.names if name not in ("response_id", "chunk")]


class Assembling(StatefulProcessor):
    """Keeps the pieces of a response until all are there and lets it pass once; what is not whole after `ttl_ms` is forgotten, if that is given (then with a processing-time trigger only)."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", T.StructType([T.StructField("yes", T.BooleanType())]), self.ttl_ms)
        self.pieces = handle.getMapState("pieces", T.StructType([T.StructField("chunk", T.IntegerType())]), T.StructType([CHUNKS[name] for name in PIECE]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.done.exists():
            return
        for r in sorted(rows, key=lambda r: (r.received_at is not None, r.received_at, r.data is not None, r.data)):  # a response's own pieces
            if not self.pieces.containsKey((r.chunk,)):
                self.pieces.updateValue((r.chunk,), tuple(r[name] for name in PIECE))
        held = {k[0]: dict(zip(PIECE, v, strict=True)) for k, v in self.pieces.iterator()}
        if len(held) < max(v["chunks"] for v in held.values()):
            return
        self.done.update((True,))
        self.pieces.clear()
        for chunk, v in held.items():
            yield Row(**{name: key[0] if name == "response_id" else chunk if name == "chunk" else v[name] for name in CHUNKS.names})

    def close(self) -> None:
        pass


def assembled(chunks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of whole responses from one of pieces (columns of CHUNKS): (response_id, chunk, ...) of all pieces of each response, together in one batch.

    Spark allows no aggregation after this in append mode: `landing.assembled` joins the pieces, in foreachBatch.
    """
    good = with_store(chunks).where("response_id is not null and chunk >= 0 and chunk < chunks").select(*CHUNKS.names)
    return good.groupBy("response_id").transformWithState(Assembling(ttl_ms), CHUNKS, "append", "processingTime" if ttl_ms else "none")


def start_assembling(chunks: DataFrame, path: str, checkpoint: str, every: str | None = None, ttl_ms: int | None = None) -> StreamingQuery:
    """Writes whole responses below `path`, a partition for each batch, which a repeated batch writes over."""
    writer = assembled(chunks, ttl_ms).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: landed(df).write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_posting(rows: DataFrame, url: str, path: str, keys: tuple[str, ...], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Posts a stream's rows, each key once however often a batch is repeated; what has been posted is the table at `path`."""

    def send(batch: DataFrame, number: int) -> None:
        post_once(batch, url, path, keys)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(send)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def first_within(responses: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Deduplication with bounded state: one row per key among those within the delay."""
    return responses.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
