"""Operator 1: toxicity by the nearest labelled examples.

Features are tokens (letters, digits and non-ASCII characters, A-Z
lower-cased). Every token of every example is indexed. Weights are
TF-IDF with document frequencies over all texts, times one plus the token's
evidence for the toxic label: its log-likelihood ratio, times how much purer than chance it
is, little below `evidence` and in proportion above. So evidence counts more, and nothing is
left out for want of it. Words that no example has are not features.

The nearest examples by cosine are exact. Examples that are alike stand side by side, in blocks of BLOCK_ROWS; of every
token the index holds its largest weight in each block, so a block's maxima bound all cosines in it. A text's most promising blocks
are scored first; their least cosine among the nearest rules out every block whose bound is lower, and the others are scored too.
Inside a block, common tokens are one dense product, others are read from the inverted lists, and what comes
within rounding of the nearest is computed again in full precision.
Votes, weighted by distance, are calibrated by isotonic regression over the examples,
each scored without itself. Texts that share no token with an example have no neighbours and get
the rate among examples of that kind.

Copies of a text would pass off all of its words as evidence, so of sampled texts with one label that
share one of three minhashes only one counts for evidence and calibration. Of texts with one label and equal
words one is an example. The sample is the labelled ids of
the smallest hash, at most `sample`, whatever the corpus; of several texts of an id the one of the smallest hash counts. Nothing else is
limited: every text is scored whole. Null texts count as empty; rows with a null id are held out; repeated ids are scored each; of several labels
of an id the largest holds; among examples of equal cosine the smallest ids come first; without labels every score is 0. Only id and text are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_ALNUM, byte_values, checkpointed, column, mix, pieces, powers, prefix_sums, shingles, smallest, table, word_hashes, words

SAMPLE, EVIDENCE, NEIGHBOURS = 20_000, 25.0, 15
#: Texts compared at a time; features in more than one of so many examples are dense, and at most so many are.
BLOCK_TEXTS, DENSE, DENSE_MOST = 512, 20, 512
#: Examples of a block, blocks that a text is held against first, and examples that the others are arranged around.
BLOCK_ROWS, FIRST, CENTRES = 512, 2, 32


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, features) of runs of words."""
    values = byte_values(fold=True)
    for i, j, begin, end in pieces(data, offsets, NOT_ALNUM):
        s, e = words(data, begin, end, offsets[i : j + 1], NOT_ALNUM)
        sums = prefix_sums(data[begin:end], values)
        yield i + np.searchsorted(offsets[i + 1 : j] - begin, s, "right"), mix((sums[e] - sums[s]) * powers(len(sums))[1][s])


class Vocabulary:
    """hashes: the features, in the order of their low bits; those of equal low bits stand together from `first` on."""

    def __init__(self, hashes: np.ndarray):
        self.mask = np.uint64((1 << max(10, len(hashes).bit_length() + 2)) - 1)
        self.hashes = hashes[np.lexsort((hashes, hashes & self.mask))]
        self.first = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"first": None}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are features, and the places of those."""
        if self.first is None:
            often = np.bincount((self.hashes & self.mask).astype(np.int64), minlength=int(self.mask) + 1)
            self.first = np.concatenate(([0], np.cumsum(often))).astype(np.int32)
        low = (h & self.mask).astype(np.int64)
        at, end = self.first[low], self.first[low + 1]
        on = np.flatnonzero(at < end)
        at, end, place = at[on], end[on], np.full(len(h), -1, np.int64)
        while len(on):
            hit = self.hashes[at] == h[on]
            place[on[hit]] = at[hit]
            left = ~hit & (at + 1 < end)
            on, at, end = on[left], at[left] + 1, end[left]
        on = np.flatnonzero(place >= 0)
        return on, place[on]

    def counts(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, features, times), sorted by text and feature."""
        out, n = [np.zeros(0, np.int64)], max(1, len(self.hashes))
        for doc, h in feature_hashes(*column(arr)):
            on, at = self.find(h)
            out.append(doc[on] * n + at)
        key, times = np.unique(np.concatenate(out), return_counts=True)
        return key // n, key % n, times


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones: working arrays take a number for every feature of every text."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        pa.default_memory_pool().release_unused()


def packed(x: np.ndarray) -> tuple[int, bytes]:
    """Differences of 32-bit numbers, byte by byte, compressed."""
    raw = np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(x), pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(n: int, raw: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int32)


def runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places start[0] ... end[0] - 1, start[1] ... and so on."""
    n = (end - start).astype(np.int64)
    out = np.repeat(start - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


class Index:
    """The examples' unit vectors, by example and by feature, and the features' largest weights in blocks of examples."""

    def __init__(self, idf: np.ndarray, rows: Iterable[tuple[int, int, np.ndarray, np.ndarray]], neighbours: int, block_texts: int | None = None):
        self.idf, self.k, self.block_texts = idf, neighbours, block_texts or BLOCK_TEXTS
        rows = [r for r in rows if len(r[2])]
        rows = [rows[x] for x in self._arranged(rows)]
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int8)
        self.at = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows], dtype=np.int64)))
        self.feature = np.concatenate([np.zeros(0, np.int32), *(r[2] for r in rows)]).astype(np.int32)
        self.times = np.concatenate([np.zeros(0, np.int32), *(r[3] for r in rows)]).astype(np.int32)
        self.norm = np.array([np.sqrt((w := self.weights(f, t)) @ w) for _, _, f, t in rows])
        self.ready = False

    def _arranged(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The rows' places, those that are near the same centre together."""
        if len(rows) <= BLOCK_ROWS:
            return np.arange(len(rows))
        begin = np.cumsum([0, *(len(r[2]) for r in rows[:-1])])
        feature = np.concatenate([r[2] for r in rows])
        weight = np.concatenate([self.unit(r[2], r[3]) for r in rows]).astype(np.float32)
        best, centre = np.full(len(rows), -1.0), np.zeros(len(rows), np.int64)
        for n, x in enumerate(np.linspace(0, len(rows) - 1, CENTRES).astype(int)):
            query = np.zeros(len(self.idf), np.float32)
            query[rows[x][2]] = self.unit(rows[x][2], rows[x][3])
            sims = np.add.reduceat(query[feature] * weight, begin)
            near = sims > best
            best[near], centre[near] = sims[near], n
        return np.lexsort((-best, centre))

    def __getstate__(self) -> dict:
        """Only the examples travel, compressed; what follows from them is made again where it is used."""
        return {"idf": self.idf, "k": self.k, "block_texts": self.block_texts, "ids": self.ids, "labels": self.labels, "at": self.at, "norm": self.norm, "feature": packed(self.feature), "times": packed(self.times.astype(np.int32)), "ready": False}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {c: unpacked(*state[c]) for c in ("feature", "times")}
        if self.times.max(initial=0) < 1 << 16:
            self.times = self.times.astype(np.uint16)

    def weights(self, features: np.ndarray, times: np.ndarray) -> np.ndarray:
        return (1 + np.log(times.astype(float))) * self.idf[features]

    def unit(self, features: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = self.weights(features, times)
        return w / np.sqrt(w @ w)

    def _ready(self) -> None:
        if self.ready:
            return
        n, often = len(self.ids), np.bincount(self.feature, minlength=len(self.idf))
        self.blocks = -(-n // BLOCK_ROWS)
        common = np.argsort(-often, kind="stable")[:DENSE_MOST]
        common = common[often[common] * DENSE > n]
        self.place = np.full(len(self.idf), -1, np.int32)
        self.place[common] = np.arange(len(common))
        self.grown = 1 + np.log(np.maximum(np.arange(int(self.times.max()) + 1), 1))  # of a number of times
        self.dense = np.zeros((len(common), self.blocks * BLOCK_ROWS), np.float32)
        cut = np.concatenate(([0], np.cumsum(np.where(self.place < 0, often, 0))))
        free, pairs = cut[:-1].copy(), np.empty((int(cut[-1]), 2), np.int32)  # example and weight are read together
        weights = pairs[:, 1].view(np.float32)
        for e in range(n):  # one by one: no array as long as the index is made besides it
            own = slice(self.at[e], self.at[e + 1])
            f = self.feature[own]
            w, place = self.grown[self.times[own]] * self.idf[f] / self.norm[e], self.place[f]
            self.dense[place[place >= 0], e] = w[place >= 0]
            f, w = f[place < 0], w[place < 0]
            to = free[f]
            pairs[to, 0], weights[to] = e, w
            free[f] += 1
        self.pairs = pairs.view(np.int64).ravel()
        self.dense_most = self.dense.reshape(len(common), self.blocks, BLOCK_ROWS).max(2)
        new = np.zeros(len(pairs) + 1, bool)
        new[cut[:-1]] = True
        for k in range(1, len(pairs), 1 << 18):
            end = min(k + (1 << 18), len(pairs))
            block = pairs[k - 1 : end, 0] // BLOCK_ROWS
            new[k:end] |= block[1:] != block[:-1]
        new = np.flatnonzero(new[:-1])
        # one entry per rare feature and block: the block, the largest weight, and where its inverted list begins
        self.block, self.list = pairs[new, 0] // BLOCK_ROWS, np.append(new, len(pairs)).astype(np.int32)
        self.most = np.maximum.reduceat(weights, new) if len(new) else weights
        self.first = np.searchsorted(new, cut)
        self.asked, self.ready = np.zeros(len(self.idf), bool), True

    def cosines(self, examples: np.ndarray, features: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The features rise. A small table of them tells which of the examples' features count; only those are weighed."""
        s, e = self.at[examples], self.at[examples + 1]
        begin = np.cumsum(e - s) - (e - s)
        feature = np.concatenate([self.feature[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])
        self.asked[features] = True
        both = np.flatnonzero(self.asked.take(feature))
        self.asked[features] = False
        which = np.searchsorted(begin, both, "right") - 1
        weight = (q * self.idf[features])[np.searchsorted(features, feature[both])]
        times = self.times[both + (s - begin)[which]]
        return np.bincount(which, weight * self.grown[times], len(examples)) / self.norm[examples]

    def _scored(self, near: np.ndarray, left: np.ndarray, chosen: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], without: list[int]) -> None:
        """Adds to near the cosines of each text with the examples of its chosen blocks."""
        for x in np.flatnonzero(chosen.any(0)).tolist():
            rows, s = np.flatnonzero(chosen[:, x]), x * BLOCK_ROWS
            near[rows, s : s + BLOCK_ROWS] = left[rows] @ self.dense[:, s : s + BLOCK_ROWS]
        for row, on, (entry, q), skip in zip(near, chosen, lists, without, strict=True):
            mine = np.flatnonzero(on[self.block[entry]])
            s, e = self.list[entry[mine]], self.list[entry[mine] + 1]
            pairs = self.pairs.take(runs(s, e)).view(np.int32)
            row += np.bincount(pairs[::2], pairs[1::2].view(np.float32) * np.repeat(q[mine], e - s), len(row))
            if skip >= 0:
                row[skip] = 0

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (features, unit vector, example to leave out or -1): the examples of largest cosine, by falling cosine and rising id, and their cosines."""
        if not len(self.ids):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        self._ready()
        left = np.zeros((len(queries), len(self.dense)), np.float32)
        bound, lists = np.zeros((len(queries), self.blocks)), []  # 1e-5 more than the bound, for rounding
        for x, (f, q, _) in enumerate(queries):
            place = self.place[f]
            left[x, place[place >= 0]] = q[place >= 0]
            s, e = self.first[f], self.first[f + 1]
            entry, each = runs(s, e), np.repeat(q.astype(np.float32), e - s)
            block = self.block[entry]
            bound[x] = np.bincount(block, self.most[entry] * each, self.blocks) + 1e-5
            lists.append((entry, each))
        bound += left @ self.dense_most
        # single precision is off by less than 1e-4: one rounding of 2**-24 for each of DENSE_MOST terms
        near, skip = np.zeros((len(queries), self.blocks * BLOCK_ROWS), np.float32), [w for *_, w in queries]
        tall = near.reshape(len(queries), self.blocks, BLOCK_ROWS)
        if self.blocks > FIRST:
            chosen = (bound >= np.partition(bound, -FIRST, 1)[:, -FIRST, None]) & (bound > 1e-5)
        else:
            chosen = bound > 1e-5
        self._scored(near, left, chosen, lists, skip)

        def least(seen: np.ndarray) -> float:
            return float(np.partition(seen, -self.k)[-self.k]) - 1e-4 if len(seen) >= self.k else 0.0

        bottom = [least(tall[x, chosen[x]].ravel()) for x in range(len(queries))]
        more = (bound > 1e-5) & ~chosen & (bound >= np.array(bottom)[:, None])
        if more.any():
            self._scored(near, left, more, lists, skip)
        out = []
        for row, low, (f, q, _) in zip(near, bottom, queries, strict=True):
            some = np.flatnonzero(row >= low) if low > 0 else np.flatnonzero(row > 0)
            if len(some) > self.k:
                some = some[row[some] >= least(row[some])]
            if not len(some):
                out.append((some, np.zeros(0)))
                continue
            sims = self.cosines(some, f, q)
            order = np.lexsort((self.ids[some], -np.round(sims, 12)))[: self.k]
            out.append((some[order], sims[order]))
        return out

    def nearest(self, features: np.ndarray, q: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(features, q, without)])[0]

    def vote(self, best: np.ndarray, sims: np.ndarray) -> float:
        w = 1 / (0.05 + np.maximum(0, 1 - sims))
        return float((w * self.labels[best]).sum() / w.sum())

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """The vote on each text (features, times), null if nothing is near, and its neighbours and their cosines."""
        for k in range(0, len(texts), self.block_texts):
            part = texts[k : k + self.block_texts]
            leave = without[k : k + self.block_texts] if without else [-1] * len(part)
            for best, sims in self.nearest_of([(f, self.unit(f, t) if len(f) else np.zeros(0), x) for (f, t), x in zip(part, leave, strict=True)]):
                yield self.vote(best, sims) if len(best) else None, best, sims


class Calibration:
    def __init__(self, votes: list[tuple[float | None, int]]):
        """votes: of examples, and their labels."""
        bare = [y for v, y in votes if v is None]
        self.none = sum(bare) / len(bare) if bare else 0.0
        self.steps = isotonic(np.array([v for v, _ in votes if v is not None]), np.array([y for v, y in votes if v is not None], float))

    def __call__(self, vote: float | None) -> float:
        if vote is None:
            return self.none
        return float(np.interp(vote, *self.steps)) if len(self.steps[0]) else vote


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing least-squares fit of y by x, drawn a little towards the middle."""
    stack: list[list[float]] = []
    for v in np.unique(x):
        stack.append([y[x == v].sum(), float((x == v).sum()), v, v])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            s, n, _, hi = stack.pop()
            stack[-1][0] += s
            stack[-1][1] += n
            stack[-1][3] = hi
    at = [p for _, _, lo, hi in stack for p in (lo, hi)]
    to = [(s + 0.5) / (n + 1) for s, n, _, _ in stack for _ in (0, 1)]
    return np.array(at), np.maximum.accumulate(np.array(to)) if to else np.array(to)


def _sampled(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, id_col: str) -> DataFrame:
    """(id, text, y, first) of at most `sample` labelled texts of the training fold with different words or labels; first: one of each group of near copies."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null and crc32(cast(id AS string)) % 5 != 0")
    once = checkpointed(marked.groupBy("id").agg(F.max("y").alias("y")).withColumn("at", F.xxhash64(F.lit("toxicity"), "id")))
    ids = checkpointed(smallest(once, "at", "id", sample).drop("at"))
    rows = checkpointed(docs.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "t.text", "y"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[], [], [], []]
            for _, at, h in word_hashes(*column(b.column(1)), NOT_ALNUM, fold=True):
                for s, e in zip(at[:-1], at[1:], strict=True):
                    g = shingles(h[s:e], min(5, max(1, e - s)))
                    out[3].append(int(mix(h[s:e] ^ mix(np.arange(e - s).astype(np.uint64))).sum(dtype=np.uint64).view(np.int64)))
                    for c, x in zip(out[:3], (0x51, 0x52, 0x53), strict=True):
                        c.append(int(mix(g ^ np.uint64(x << 40)).min().view(np.int64)) if len(g) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.int64()) for c in out)], names=["id", "y", "a", "b", "c", "words"])

    seen: set[tuple[int, int, int]] = set()
    kept = []
    for r in rows.mapInArrow(keys, "id long, y int, a long, b long, c long, words long").orderBy("id").toLocalIterator():  # at most `sample` rows
        own = {(r.y, n, x) for n, x in enumerate((r.a, r.b, r.c))}
        if (r.y, 3, r.words) not in seen:
            kept.append((r.id, not own & seen))
        seen |= own | {(r.y, 3, r.words)}
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "id long, first boolean")), "id")


def boost(bad: np.ndarray, n: np.ndarray, all_bad: int, all_n: int, evidence: float) -> np.ndarray:
    """What evidence for the label multiplies a feature's weight by, where bad of its n texts have it, and all_bad of all_n."""
    if not 0 < all_bad < all_n:
        return np.ones(len(n))
    p, share = all_bad / all_n, bad / np.maximum(n, 1)
    ratio = 2 * (bad * np.log(np.maximum(share, 1e-300) / p) + (n - bad) * np.log(np.maximum(1 - share, 1e-300) / (1 - p)))
    x = np.where(share > p, np.maximum(ratio, 0) * (share - p) / (1 - p), 0)
    return 1 + x * x / (x + evidence)


def _texts(vocabulary: Vocabulary, arr: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    doc, f, t = vocabulary.counts(arr)
    cut = np.searchsorted(doc, np.arange(len(arr) + 1))
    return [(f[s:e], t[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, evidence: float = EVIDENCE, neighbours: int = NEIGHBOURS, id_col: str = "doc_id", block_texts: int = BLOCK_TEXTS) -> tuple[Broadcast, Broadcast, Calibration]:
    """The vocabulary and the index on every worker, and the calibration; docs: (id, text)."""
    sc = docs.sparkSession.sparkContext
    rows = _sampled(docs, labels, label_col, sample, id_col)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, first = (np.array(b.column(i).to_pylist(), np.int64) for i in (1, 2))
            for doc, h in feature_hashes(*column(b.column(0))):
                order = np.lexsort((h, doc))
                d, g = doc[order], h[order]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (g[1:] != g[:-1]))) if len(d) else np.zeros(0, bool)
                keys, at = np.unique(g[new], return_inverse=True)
                sums = (np.bincount(at, w[d[new]], len(keys)).astype(np.int64) for w in ((y > 0) * first, first))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(x) for x in sums)], names=["h", "bad", "n"])

    total, bad = rows.where("first").agg(F.count("*"), F.coalesce(F.count_if(F.col("y") > 0), F.lit(0))).first()
    counted = rows.select("text", "y", "first").mapInArrow(seen, "h long, bad long, n long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).toArrow()  # one row per feature of the sample
    hashes, times_bad, times = (counted[c].to_numpy() for c in ("h", "bad", "n"))
    vocabulary = Vocabulary(hashes.view(np.uint64))
    order = np.lexsort((hashes.view(np.uint64), hashes.view(np.uint64) & vocabulary.mask))
    more = boost(times_bad[order].astype(float), times[order].astype(float), bad, total, evidence)
    del counted, hashes, times_bad, times, order
    words = sc.broadcast(vocabulary)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(words.value.hashes), np.int64), 0
        for b in parts(batches):
            n += b.num_rows
            total += np.bincount(words.value.counts(b.column(0))[1], minlength=len(total))[: len(total)]
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1).astype(np.int32)), pa.array(np.append(total[on], n))], names=["at", "n"])

    df, n_docs = np.zeros(len(vocabulary.hashes)), 1
    if len(df):
        got = docs.select("text").mapInArrow(frequency, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # one row per feature
        at, n = got["at"].to_numpy(), got["n"].to_numpy()
        n_docs = max(1, int(n[at < 0].sum()))
        df[at[at >= 0]] = n[at >= 0]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            doc, f, t = words.value.counts(b.column(1))
            cut = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (f, t))], names=["id", "y", "f", "t"])

    got = rows.select("id", "text", "y").mapInArrow(vectors, "id long, y int, f array<int>, t array<int>").toArrow()  # at most `sample`
    each = zip(got["id"].to_pylist(), got["y"].to_pylist(), got["f"], got["t"], strict=True)
    examples = sorted(((i, int(y > 0), f.values.to_numpy(), t.values.to_numpy()) for i, y, f, t in each), key=lambda r: r[0])
    index = Index(np.log(1 + n_docs / (1 + df)) * more, examples, neighbours, block_texts)
    ready = sc.broadcast(index)
    del got, examples, index

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = words.value, ready.value
        place = {int(i): n for n, i in enumerate(index.ids)}
        for b in parts(batches):
            out = [v for v, _, _ in index.votes(_texts(vocabulary, b.column(1)), [place.get(i, -1) for i in b.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(out, pa.float64())], names=["y", "vote"])

    examples = rows.where("first").select("id", "text", "y").repartition(max(1, min(64, total // 1000)), "id")
    got = examples.mapInArrow(votes, "y int, vote double").collect() if total else []  # at most `sample`
    return words, ready, Calibration([(r.vote, int(r.y > 0)) for r in got])


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, held_out, score, predicted, and evidence: the examples' ids, cosines and labels."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words, ready, calibrated = fit(rows, labels, id_col=id_col, **options)
    struct = pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = words.value, ready.value
        for b in parts(batches):
            votes, best, sims = zip(*index.votes(_texts(vocabulary, b.column(1))), strict=True) if b.num_rows else ([], [], [])
            at = pa.array(np.cumsum([0, *map(len, best)]).astype(np.int32))
            near, cosine = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((best, np.int64), (sims, float)))
            why = pa.StructArray.from_arrays([pa.array(index.ids[near]), pa.array(cosine), pa.array(index.labels[near].astype(np.int32))], fields=list(struct))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([calibrated(v) for v in votes], pa.float64()), pa.ListArray.from_arrays(at, why)], names=["id", "score", "evidence"])

    scored = rows.mapInArrow(run, "id long, score double, evidence array<struct<id: long, cosine: double, label: int>>")
    return scored.select(F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns; nothing is shuffled. Texts go in small blocks, for memory."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words, ready, calibrated = fit(rows, labels, id_col=id_col, **{"block_texts": 128, **options})
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = words.value, ready.value
        for b in parts(batches):
            keep = [calibrated(vote) < threshold for vote, _, _ in index.votes(_texts(vocabulary, b.column(at)))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
