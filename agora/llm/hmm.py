"""Operator 7: language-model scores by a hidden Markov model.

Tokens are words (A-Z lower-cased) and one end per text. Counts of every
training token come from one shuffle: each mapper sends, for its block of texts,
the words' 64-bit hashes with the texts they stand in, packed by hash bucket; a
bucket adds up the training counts and sends back, for each text of the block,
its sum of log10(count + 0.1) and its number of known tokens.

The model emits the `vocab` most frequent training tokens themselves and all
others as one class, inside which a token has its smoothed unigram probability;
so a text's score is a proper probability of its exact tokens. The states start
from groups of frequent words that stand together. Baum-Welch then passes over
all training texts `passes` times: every partition sums expected starts, transitions
and emissions by scaled forward-backward, and the sums meet by key. Both training and scores are those of whole
texts: they are worked on in stretches of 64 tokens side by side, each stretch
becomes one scaled transfer matrix, and the recursions run over those first, so that every stretch begins with what comes before and ends with
what comes after.

Null and empty texts are one end. Rows with equal ids are scored each for
itself. Ids are integers (-2**63 counts as null, and null ids are held out); only the id and the text are read. Without training texts every count is 0 and the model is uniform.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, column, shuffle_partitions, table, word_hashes

STATES, VOCAB, PASSES, STRETCH, SEEDS = 6, 4096, 4, 64, 256
#: Words that a mapper gathers before it sends them on.
GATHER = 1 << 20
#: Bytes of text for one bucket, at most, and hashes that a task looks at together.
BUCKET_BYTES, KEYS = 1 << 30, 1 << 20
END = np.uint64(0xE17D_0F7E_47A1_5EED)
#: Stands for a null id inside; such texts are held out.
NO_ID = -(1 << 63)


def training(doc_id: int) -> bool:
    return doc_id != NO_ID and zlib.crc32(str(doc_id).encode()) % 10 != 0


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, offsets, token hashes) of runs of texts; every text ends with END."""
    for b in batches:
        ids = b.column(0).to_pylist()
        for first, at, h in word_hashes(*column(b.column(1)), SPACE, fold=True):
            n = len(at) - 1
            yield ids[first : first + n], at + np.arange(n + 1), np.insert(h, at[1:], END)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    held, n = [], 0
    for run in runs(batches):
        held.append(run)
        n += len(run[2])
        if n >= limit:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[list, np.ndarray, np.ndarray]:
    sizes = np.concatenate([np.diff(at) for _, at, _ in held])
    return [i for ids, _, _ in held for i in ids], np.concatenate(([0], np.cumsum(sizes))), np.concatenate([h for _, _, h in held])


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for ids, at, h in gathered(batches, max(GATHER, 64 * buckets)):
            marks = np.add.reduceat(h, at[:-1]).tobytes()
            doc = np.repeat(np.arange(len(ids), dtype=np.uint32), np.diff(at))
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
            tf = np.diff(np.append(new, len(h))).astype(np.uint32)
            h, doc = h[new], doc[new]
            train = np.array([training(i) for i in ids], np.uint8)
            share = (h >> np.uint64(32)).astype(np.int64) * buckets >> 32
            cut = np.searchsorted(share, np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                s, e = cut[k], cut[k + 1]
                u = np.flatnonzero(np.concatenate(([True], h[s + 1 : e] != h[s : e - 1])))
                docs, local = np.unique(doc[s:e], return_inverse=True)
                rows.append((block, k, h[s:e][u].tobytes(), np.diff(np.append(u, e - s)).astype(np.uint32).tobytes(), docs.astype(np.uint32).tobytes(), local.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32).tobytes(), tf[s:e].astype(np.uint16 if tf[s:e].max() < 1 << 16 else np.uint32).tobytes(), train[docs].tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(SENT.names, r, strict=True)) for r in rows], schema=SENT)
            yield pa.RecordBatch.from_pylist([{"block": block, "bucket": -1, "hashes": np.array(ids, np.int64).tobytes(), "docs": np.diff(at).astype(np.int64).tobytes(), "times": marks}], schema=SENT)
            block += 1

    return run


SENT = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("hashes", "times", "docs", "local", "tf", "train"))])


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def _ranges(hashes: list[np.ndarray], limit: int) -> Iterator[list[tuple[int, int]]]:
    """Ranges of the hashes with about `limit` of them each: where each of the sorted arrays begins and ends in the range."""
    filled = [h for h in hashes if len(h)]
    lo, hi = (min(int(h[0]) for h in filled), max(int(h[-1]) for h in filled)) if filled else (0, 0)
    n = max(1, -(-sum(map(len, hashes)) // limit))
    bounds = np.array([lo + (hi - lo + 1) * k // n for k in range(n)], np.uint64)
    cuts = [np.append(np.searchsorted(h, bounds), len(h)).tolist() for h in hashes]
    for k in range(n):
        yield [(c[k], c[k + 1]) for c in cuts]


def _count(vocab: int):
    """Rows of a bucket in, its sums for every block out, with the bucket's totals and most frequent tokens. Hashes are looked at in ranges of KEYS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] < 0:
                    yield pa.RecordBatch.from_pylist([{"block": r["block"], "docs": None, "ids": r["hashes"], "sizes": r["docs"], "marks": r["times"]}], schema=COUNTED)
                else:
                    rows.append(r)
        hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        times = [np.frombuffer(r["times"], np.uint32) for r in rows]
        begins = [np.concatenate(([0], np.cumsum(t, dtype=np.int64))) for t in times]
        sums = [np.zeros(len(r["docs"]) // 4) for r in rows]
        seen = [np.zeros(len(r["docs"]) // 4, np.int64) for r in rows]
        for cut in _ranges(hashes, KEYS) if rows else ():
            part, own = [], []
            for r, h, t, begin, (s, e) in zip(rows, hashes, times, begins, cut, strict=True):
                if s == e:
                    continue
                local, tf = (_unpack(r[c], int(begin[-1]))[begin[s] : begin[e]] for c in ("local", "tf"))
                train = np.frombuffer(r["train"], np.uint8)
                part.append((h[s:e], t[s:e], local, tf))
                own.append(np.add.reduceat(tf * train[local].astype(np.int64), begin[s:e] - begin[s]))
            if not part:
                continue
            keys, at = np.unique(np.concatenate([p[0] for p in part]), return_inverse=True)
            c = np.bincount(at, np.concatenate(own), len(keys)).astype(np.int64)
            known = keys[c > 0]
            top = np.argsort(-c[c > 0], kind="stable")[:vocab]
            yield pa.RecordBatch.from_pylist([{"n": int(c.sum()), "v": len(known), "top": known[top].view(np.int64).tolist(), "top_n": c[c > 0][top].tolist()}], schema=COUNTED)
            values, k, of_row = np.log10(c + 0.1), 0, iter(part)
            for x, (s, e) in enumerate(cut):
                if s == e:
                    continue
                _, t, local, tf = next(of_row)
                of = at[k : k + e - s]
                k += e - s
                sums[x] += np.bincount(local, np.repeat(values[of], t) * tf, len(sums[x]))
                seen[x] += np.bincount(local, np.repeat(c[of] > 0, t) * tf, len(sums[x])).astype(np.int64)
        for r, x, y in zip(rows, sums, seen, strict=True):
            yield pa.RecordBatch.from_pylist([{"block": r["block"], "docs": r["docs"], "sums": x.tobytes(), "seen": y.astype(np.uint32).tobytes()}], schema=COUNTED)

    return run


COUNTED = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("docs", "sums", "seen", "ids", "sizes", "marks")), ("n", pa.int64()), ("v", pa.int64()), ("top", pa.list_(pa.int64())), ("top_n", pa.list_(pa.int64()))])
COUNTED_DDL = "block long, docs binary, sums binary, seen binary, ids binary, sizes binary, marks binary, n long, v long, top array<long>, top_n array<long>"


def _meet(key: tuple, t: pa.Table) -> pa.Table:
    """The sums of one block's texts over all buckets."""
    rows = t.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    ids, sizes = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["sizes"], np.int64)
    sums, seen = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for r in sorted((r for r in rows if r["docs"] is not None), key=lambda r: (len(r["docs"]), r["docs"], r["sums"])):
        docs = np.frombuffer(r["docs"], np.uint32)
        sums[docs] += np.frombuffer(r["sums"], np.float64)
        seen[docs] += np.frombuffer(r["seen"], np.uint32)
    return pa.table({"id": ids, "n_tokens": sizes, "mark": np.frombuffer(head["marks"], np.int64), "sums": sums, "seen": seen})


class Model:
    """hashes: the vocabulary, sorted; symbols are places in it, then one for other tokens."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, states: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.n, self.v, self.k = n, v, states
        rest = max(0, n - int(counts.sum()))
        self.unigram = np.append(self.counts, rest).astype(float) + 1
        self.log_count = np.append(np.log10(self.counts + 0.1), 0.0)
        self.rest_log = np.log10(rest + 0.1 * (v - len(hashes) + 1))
        self.start = np.full(states, 1 / states)
        self.step = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(self.step, 0.95 if states > 1 else 1.0)
        self.emit = np.tile(self.unigram / self.unigram.sum(), (states, 1))

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, len(self.hashes))

    def seed(self, words: np.ndarray, together: np.ndarray) -> None:
        """Emissions from groups of the given symbols, by how often they stand in a stretch together."""
        if len(words) < self.k or not together.any():
            return
        g = np.sqrt((together + 0.1) / (together + 0.1).sum(1, keepdims=True))
        weight = np.sqrt(np.diag(together) + 1)
        chosen = [int(weight.argmax())]
        while len(chosen) < self.k:
            far = np.min([np.sum((g - g[c]) ** 2, 1) for c in chosen], 0)
            chosen.append(int((far * weight).argmax()))
        centre = g[chosen]
        for _ in range(8):
            group = np.argmin(((g[:, None] - centre[None]) ** 2).sum(2), 1)
            centre = np.array([np.average(g[group == c], 0, weight[group == c]) if (group == c).any() else centre[c] for c in range(self.k)])
        share = centre**2 / (centre**2).sum(1, keepdims=True)
        self.emit[:, words] = 0.999 * share * self.emit[:, words].sum(1, keepdims=True) + 0.001 * self.emit[:, words]
        self.emit /= self.emit.sum(1, keepdims=True)

    def update(self, counts: np.ndarray) -> None:
        k = self.k
        self.start = counts[:k] + 0.1
        self.step = counts[k : k + k * k].reshape(k, k) + 0.1
        self.emit = counts[k + k * k :].reshape(k, -1) + 0.02 * self.unigram / self.unigram.sum() * len(self.unigram)
        self.start, self.step, self.emit = (x / x.sum(-1, keepdims=True) for x in (self.start, self.step, self.emit))


def stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, document) of stretches of at most STRETCH tokens, the longest first."""
    n = -(-sizes // STRETCH)
    doc = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(sizes) - sizes)[doc] + nth * STRETCH
    length = np.minimum(STRETCH, sizes[doc] - nth * STRETCH)
    return begin, length, doc


def transfers(model: Model, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begins, lengths, whether they begin a text, scaled transfer matrices, their log10 scales) of the stretches, in the order of the texts."""
    begin, length, doc = stretches(sizes)
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    order = np.argsort(-length, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    b, n_of = begin[order], length[order]
    emit, k = np.ascontiguousarray(model.emit.T), model.k
    move = np.where(first[order][:, None, None], np.eye(k), model.step) * emit[sym[b]][:, None, :]
    logs = np.zeros(len(b))
    for t in range(1, int(n_of[0])):
        n = int(np.searchsorted(-n_of, -t, "left"))
        move[:n] = (move[:n].reshape(-1, k) @ model.step).reshape(n, k, k) * emit[sym[b[:n] + t]][:, None, :]
        if t % 12 == 0:
            c = move[:n].sum((1, 2))
            move[:n] /= c[:, None, None]
            logs[:n] += np.log10(c)
    return begin, length, first, move[back], logs[back]


def expected(model: Model, sym: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Expected starts, transitions and emissions of the texts, each a sequence from its start to its end."""
    begin, length, first, move, _ = transfers(model, sym, sizes)
    n = -(-sizes // STRETCH)
    at = np.cumsum(n) - n
    before, after = np.tile(model.start, (len(begin), 1)), np.ones((len(begin), model.k))
    for t in range(1, int(n.max(initial=0))):  # what comes in at the begin of the t-th stretch
        on = at[n > t] + t
        a = np.einsum("ni,nij->nj", before[on - 1], move[on - 1])
        before[on] = a / a.sum(1, keepdims=True)
    for t in range(1, int(n.max(initial=0))):  # and at the end of the t-th from the last
        on = (at + n)[n > t] - 1 - t
        z = np.einsum("nij,nj->ni", move[on + 1], after[on + 1])
        after[on] = z / z.sum(1, keepdims=True)
    order = np.argsort(-length, kind="stable")
    begin, length, first, before, after = (x[order] for x in (begin, length, first, before, after))
    k, emit = model.k, np.ascontiguousarray(model.emit.T)
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]
    alpha, scale = [], []
    for t, n in enumerate(active):
        a = emit[sym[begin[:n] + t]] * (np.where(first[:, None], before, before @ model.step) if t == 0 else alpha[-1][:n] @ model.step)
        c = a.sum(1, keepdims=True)
        alpha.append(a / c)
        scale.append(c)
    last = np.empty((len(begin), k))
    for t, n in enumerate(active):
        last[:n] = alpha[t]
    gamma = np.empty((len(sym), k))
    steps, beta = np.zeros((k, k)), after / (last * after).sum(1, keepdims=True)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        g = alpha[t] * beta[:n]
        gamma[begin[:n] + t] = g / g.sum(1, keepdims=True)
        right = beta[:n] * emit[sym[begin[:n] + t]] / scale[t]
        steps += (alpha[t - 1][:n] if t else np.where(first[:, None], 0, before)).T @ right
        beta[:n] = right @ model.step.T
    return np.concatenate((gamma[begin[first]].sum(0), (steps * model.step).ravel(), *(np.bincount(sym, gamma[:, s], len(emit)) for s in range(k))))


def forward(model: Model, sym: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of each text's symbols, by the forward recursion over the stretches' transfer matrices."""
    *_, move, logs = transfers(model, sym, sizes)
    n = -(-sizes // STRETCH)
    at = np.cumsum(n) - n
    alpha, out = np.tile(model.start, (len(sizes), 1)), np.zeros(len(sizes))
    for t in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > t)
        a = np.einsum("ni,nij->nj", alpha[on], move[at[on] + t])
        c = a.sum(1)
        alpha[on] = a / c[:, None]
        out[on] += np.log10(c) + logs[at[on] + t]
    return out


def _summed(rows: DataFrame, make: Callable[[list, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of the vectors that make gives for their training texts; partitions meet by place."""
    sent = rows.sparkSession.sparkContext.broadcast(make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for ids, at, h in runs(batches):
            sizes = np.diff(at)
            train = np.array([training(i) for i in ids], bool)
            if train.any():
                total += sent.value(h[np.repeat(train, sizes)], sizes[train])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "value"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # one row per parameter
        out[r["at"]] = r["value"]
    return out


class Together:
    """How often each two of the words stand in one stretch."""

    def __init__(self, model: Model, words: np.ndarray):
        self.model, self.place = model, np.full(len(model.hashes) + 1, -1)
        self.place[words] = np.arange(len(words))
        self.n = len(words)

    def __call__(self, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        begin, length, _ = stretches(sizes)
        w = self.place[self.model.symbols(h)]
        of = np.repeat(np.arange(len(begin)), length)
        seen = np.zeros((len(begin), self.n), np.float32)
        seen[of[w >= 0], w[w >= 0]] = 1
        return (seen.T @ seen).ravel().astype(float)


class Expected:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return expected(self.model, self.model.symbols(h), sizes)


def train(rows: DataFrame, model: Model, passes: int) -> Model:
    k = model.k
    words = np.sort(np.argsort(-model.counts, kind="stable")[:SEEDS])
    if not len(words):
        return model
    model.seed(words, _summed(rows, Together(model, words), len(words) ** 2).reshape(len(words), -1))
    for _ in range(passes):
        model.update(_summed(rows, Expected(model), k + k * k + k * len(model.unigram)))
    return model


def most_frequent(tops: DataFrame, vocab: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The vocab most frequent tokens and their counts, from every bucket's own; about the square root of the buckets meet at the driver."""

    def merge(rows: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(r[i], np.int64) for r in rows)]) for i in (0, 1))
        order = np.lexsort((h, -n))[:vocab]
        return h[order], n[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = merge([])
        for b in batches:
            for r in b.to_pylist():
                best = merge([best, (r["top"], r["top_n"])])
        yield pa.RecordBatch.from_pylist([{"top": best[0].tolist(), "top_n": best[1].tolist()}], schema=pa.schema([("top", pa.list_(pa.int64())), ("top_n", pa.list_(pa.int64()))]))

    some = tops.repartition(int(np.ceil(np.sqrt(parts)))).mapInArrow(run, "top array<long>, top_n array<long>")
    h, n = merge([tuple(r) for r in some.collect()])
    return h.view(np.uint64), n


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, vocab: int = VOCAB, passes: int = PASSES) -> DataFrame:
    """id (long), held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    sent = rows.mapInArrow(_send(parts), "block long, bucket int, hashes binary, times binary, docs binary, local binary, tf binary, train binary")
    to = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    counted = checkpointed(sent.repartitionById(parts, to).mapInArrow(_count(vocab), COUNTED_DDL))
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    top = most_frequent(counted.where("top is not null").select("top", "top_n"), vocab, parts)
    model = Model(*top, n, v, states)
    model = train(rows, model, passes)
    ready = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ready.value
        for ids, at, h in runs(batches):
            sizes = np.diff(at)
            sym = m.symbols(h)
            other = sym == len(m.hashes)
            known = np.add.reduceat(m.log_count[sym], at[:-1])
            rest = np.add.reduceat(other.astype(np.int64), at[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(np.add.reduceat(h, at[:-1]).view(np.int64)), pa.array(forward(m, sym, sizes) - known - rest * m.rest_log)], names=["id", "n_tokens", "mark", "hmm"])

    scored = rows.mapInArrow(run, "id long, n_tokens long, mark long, hmm double")
    base = counted.where("block is not null").groupBy("block").applyInArrow(_meet, "id long, n_tokens long, mark long, sums double, seen long")
    base = base.groupBy("id", "n_tokens", "mark").agg(F.first("sums").alias("sums"), F.first("seen").alias("n_known"))  # equal tokens, equal sums
    total = float(np.log10(n + 0.1 * (v + 1)))
    held_out = (F.col("id") == NO_ID) | (F.crc32(F.col("id").cast("string")) % 10 == 0)
    return scored.join(base, ["id", "n_tokens", "mark"]).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sums") - F.col("n_tokens") * total).alias("base_score"),
        (F.col("hmm") + F.col("sums")).alias("score"),
    )


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
