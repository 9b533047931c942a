"""Operator 5: near-duplicates by ProbMinHash.

Texts are multisets of shingles of five words (white space separates; a shorter
text is one shingle of all its words), weighted by how often they occur. Every shingle
starts a Poisson process whose rate is its weight; each arrival falls on one of
the signature's components, and a component keeps its first. Arrivals past the
time at which all components are taken can change nothing and are not drawn. Two
texts agree in a component with the probability Jaccard similarity of their
weights. Bands of the signature give candidates, and the similarity itself, computed from the
shingles, decides: at least `threshold`.

Texts of equal words are one class from the start, and only its representative
goes on. In every bucket of a band the others are compared with a leader, the
member that shares most with others; never all with all. Where that leaves
members in different components, the next leader follows; after `ROUNDS` leaders
what is left of each bucket is compared in blocks of fixed size, where a pair is skipped only if it
is connected already or meets in an earlier band. So no candidate is dropped, and no pairs are written. The classes are the
connected components, found by label propagation with pointer jumping.

A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**26, about
3e-5. Null and empty texts have no words and are one class. Rows that share an
id are one document if their words are equal; else each is compared by its own words,
and classes whose smallest id is the same have the same class_id. Inside, a 63-bit number made
from the words stands for a text; ids come in at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, column, few, mix, table, word_hashes

WORDS, THRESHOLD, BANDS, ROWS, ROUNDS, BLOCK_ROWS = 5, 0.8, 26, 5, 2, 256


def weighted(h: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, shingles, weights), sorted by both, of texts whose words are h[at[i]:at[i + 1]]."""
    n = np.diff(at)
    g, start = np.zeros(len(h), np.uint64), np.arange(len(h))
    end = np.repeat(at[1:], n)
    doc = np.repeat(np.arange(len(n)), n)
    first = start == np.repeat(at[:-1], n)
    keep = (start + k <= end) | first
    for x in range(k):
        on = np.flatnonzero(start + x < end)
        g[on] = g[on] * np.uint64(0xD6E8FEB86659FD93) + h[on + x]
    g, doc = mix(g[keep]), doc[keep]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])))) if len(g) else np.zeros(0, np.int64)
    return doc[new], g[new], np.diff(np.append(new, len(g)))


def signatures(doc: np.ndarray, g: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """The shingle that arrives first in each of m components, for each of n texts; 0 for texts without shingles."""
    total = np.bincount(doc, weight, n)
    taken, out = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    taken.reshape(n, m)[total == 0] = 0
    limit = m * (np.log(m) + 2) / np.maximum(total, 1e-9)
    at, state, t = np.arange(len(g)), g.copy(), np.zeros(len(g))

    def arrive(at: np.ndarray, state: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        return at, state, t - np.log(u) / weight[at]

    at, state, t = arrive(at, state, t)
    while True:
        later = []
        while len(at):  # arrivals up to the limit; what comes after it waits
            due = t <= limit[doc[at]]
            if not due.all():
                later.append((at[~due], state[~due], t[~due]))
                at, state, t = at[due], state[due], t[due]
            place = doc[at] * m + ((mix(state ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(taken, place, t)
            won = taken[place] == t
            out[place[won]] = g[at[won]]
            at, state, t = arrive(at, state, t)
        open_ = np.isinf(taken.reshape(n, m)).any(1)
        if not open_.any():
            return out.reshape(n, m)
        limit[open_] *= 1.5
        at, state, t = (np.concatenate(x) for x in zip(*later, strict=True))
        keep = open_[doc[at]]
        at, state, t = at[keep], state[keep], t[keep]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> float:
    """Probability Jaccard of two weighted sets, each as (sorted elements, weights); 0 if it is clearly below `least`."""
    (g, v), (h, w) = a, b
    at = np.searchsorted(h, g)
    both = h[np.minimum(at, len(h) - 1)] == g if len(h) else np.zeros(len(g), bool)
    x, y = v[both].astype(float), w[at[both]].astype(float)
    p, q = float(v.sum()), float(w.sum())
    if np.minimum(x / p, y / q).sum() < least * (1 - 1e-9):  # each term is at most the element's share of either text
        return 0.0
    ratio = y / x
    if (ratio == 1).all():
        return float(x.sum() / (p + q - x.sum()))
    return float(sum(x[ratio == r].sum() / (np.maximum(x, y / r).sum() + (p - x.sum()) + (q - y.sum()) / r) for r in np.unique(ratio)))


def pack(g: np.ndarray, w: np.ndarray) -> bytes:
    return g.tobytes() + (b"" if (w == 1).all() else w.astype(np.uint32).tobytes())


def unpack(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n) if len(raw) > 8 * n else np.ones(n, np.uint32)


def numbers(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each text's words in their order, and the number made from both that stands for the text."""
    n = len(at) - 1
    pos = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    doc = np.repeat(np.arange(n), np.diff(at))
    same = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        x = np.zeros(n, np.uint64)
        np.add.at(x, doc, mix(h ^ mix(pos.astype(np.uint64) + np.uint64(salt))))
        same.append(x)
    return same[0].view(np.int64), same[1].view(np.int64), (mix(same[0] ^ mix(same[1])) >> np.uint64(1)).view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, at, h in word_hashes(*column(b.column(1))):
                n = len(at) - 1
                sig = signatures(*weighted(h, at), n, bands * rows).reshape(n, bands, rows)
                key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], n, 0)
                for r in range(rows):
                    key = mix(key * np.uint64(0xE7037ED1A0B428DB) + sig[:, :, r])
                same = [pa.array(x) for x in numbers(h, at)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), *same, pa.array(np.diff(at)), flat], names=["id", "ka", "kb", "rep", "n_words", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text of (id, text, reps) whose number is in reps, once; all rows of an id come to one task."""
    seen: set[int] = set()
    for b in batches:
        wanted = b.column(2).to_pylist()
        for first, at, h in word_hashes(*column(b.column(1))):
            doc, g, w = weighted(h, at)
            cut = np.searchsorted(doc, np.arange(len(at)))
            out = []
            for k, rep in enumerate(numbers(h, at)[2].tolist()):
                if rep in wanted[first + k] and rep not in seen:
                    seen.add(rep)
                    s, e = cut[k], cut[k + 1]
                    out.append((rep, int(e - s), pack(g[s:e], w[s:e])))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["rep", "n", "set"])


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z, n, x, m, y = b.columns
            ok = np.array([similarity(unpack(x[i].as_py(), n[i].as_py()), unpack(y[i].as_py(), m[i].as_py()), threshold) >= threshold for i in range(b.num_rows)], bool)
            yield pa.RecordBatch.from_arrays([a, z, pa.array(ok)], names=["a", "b", "ok"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex c of each vertex's connected component; edges are (a, b)."""
    both = checkpointed(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), forget=True)
    n = few(both.count(), edges.sparkSession)
    both = both.coalesce(n)
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("c")).coalesce(n), forget=True)
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").coalesce(n).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m")).coalesce(n)
        step = labels.join(near, "v").select("v", F.least("c", "m").alias("c"), F.col("c").alias("old")).coalesce(n)
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("to"))
        new = checkpointed(step.join(jump, "c").select("v", F.col("to").alias("c"), (F.col("to") != F.col("old")).alias("moved")).coalesce(n), forget=True)
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels


def _blocks(threshold: float):
    """Links between two blocks of a bucket: pairs not yet connected are verified, each in the first of the bands that it shares; only links that connect are returned."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rep, comp, n = (t[c].to_pylist() for c in ("rep", "c", "n"))
        raw, left, right = t["set"], np.array(t["left"]), np.array(t["right"])
        bands = np.array(t["bands"].to_pylist(), np.int64)
        i, j = np.flatnonzero(left), np.flatnonzero(right)
        labels = np.array(comp)
        open_ = labels[i][:, None] != labels[j][None]
        for k in range(int(np.flatnonzero(bands[0] == key[0].as_py())[0])):
            open_ &= bands[i, k][:, None] != bands[j, k][None]
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for x, y in zip(*(a.tolist() for a in np.nonzero(open_)), strict=True):
            x, y = int(i[x]), int(j[y])
            if (ca := top(comp[x])) == (cb := top(comp[y])):
                continue
            for z in (x, y):
                if z not in sets:
                    sets[z] = unpack(raw[z].as_py(), n[z])
            if similarity(sets[x], sets[y], threshold) >= threshold:
                up[max(ca, cb)] = min(ca, cb)
                out.append((max(rep[x], rep[y]), min(rep[x], rep[y])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def rest(at: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among what the leaders have left, open buckets (key, rep, c): no two components of a bucket stay apart that a link connects.

    Every bucket is done by itself, so buckets that share members don't grow together. Its largest component is main; the
    members of the others are compared with each other and with the main ones, in blocks of BLOCK_ROWS, so main members
    never meet each other.
    """
    size = at.groupBy("key", "c").agg(F.count("*").alias("k"))
    main = size.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("km"), (F.sum("k") - F.max("k")).alias("ks"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS)
    rows = at.join(main.where("ks > 0"), "key").withColumns({"is_main": F.col("c") == F.col("main"), "km": blocks("km"), "ks": blocks("ks")})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("km")).otherwise(F.col("ks"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    pair = lambda i, j, m, left, right: F.struct(i.alias("i"), j.alias("j"), F.lit(m).alias("m"), left.alias("left"), right.alias("right"))
    no, yes, mine = F.lit(False), F.lit(True), F.col("own")
    others = F.transform(upto("ks"), lambda j: pair(F.least(mine, j), F.greatest(mine, j), False, mine <= j, mine >= j))
    mains = F.transform(upto("km"), lambda j: pair(mine, j, True, yes, no))
    from_main = F.transform(upto("ks"), lambda i: pair(i, mine, True, no, yes))
    dealt = F.when(F.col("is_main"), from_main).otherwise(F.concat(others, mains))
    full = rows.select("key", "rep", "c", dealt.alias("p")).join(sets, "rep").join(reps.select("rep", "bands"), "rep").select("key", "rep", "c", "n", "set", "bands", F.explode("p").alias("p"))
    return full.select("key", "rep", "c", "n", "set", "bands", "p.*").groupBy("key", "i", "j", "m").applyInArrow(_blocks(threshold), "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (the smallest id of the class) and rep_id (the smallest id with equal words) of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = checkpointed(texts.mapInArrow(_sign(bands, rows), "id long, ka long, kb long, rep long, n_words long, bands array<long>"))
    members = signed.select("id", "ka", "kb")
    reps = checkpointed(signed.groupBy("ka", "kb").agg(F.first("rep").alias("rep"), F.min("id").alias("own"), F.first("bands").alias("bands"), F.max("n_words").alias("n_words")))
    banded = reps.where("n_words > 0 and own is not null").select("rep", F.explode("bands").alias("key"))
    full = checkpointed(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    live = checkpointed(banded.join(full, "key"))
    shares = live.groupBy("rep").agg(F.sum("n").alias("s"))
    wanted = live.select("rep").distinct().join(reps.select("rep", F.col("own").alias("id")), "rep").groupBy("id").agg(F.collect_set("rep").alias("reps"))
    sets = checkpointed(texts.join(wanted, "id").dropDuplicates(["id", "text"]).select("id", "text", "reps").mapInArrow(_sets, "rep long, n long, set binary"))
    live = checkpointed(live.drop("n").join(shares, "rep"))
    n = few(live.count(), live.sparkSession)
    edges = None
    found = live.sparkSession.createDataFrame([], "v long, c long")
    for turn in range(ROUNDS + 1):
        at = live.join(found.withColumnRenamed("v", "rep"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
        if turn:  # buckets of one component are done
            open_ = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
            at = checkpointed(at.coalesce(n).join(open_.coalesce(n), "key", "left_semi").coalesce(n))
            if at.isEmpty():
                break
        if turn == ROUNDS:
            links = checkpointed(rest(at, reps, sets, threshold))
        else:
            lead = checkpointed(at.groupBy("key").agg(F.max(F.struct("s", (-F.col("rep")).alias("neg"), "c")).alias("lead")).select("key", (-F.col("lead.neg")).alias("b"), F.col("lead.c").alias("cb")).coalesce(n))
            pairs = at.join(lead, "key").where("c != cb").select(F.col("rep").alias("a"), "b").coalesce(n).distinct()
            live = checkpointed(at.drop("c").join(lead.select("key", "b"), "key").where("rep != b").drop("b").coalesce(n))
            left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("set").alias("xa")), "a")
            both = left.join(sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("set").alias("xb")), "b").select("a", "b", "na", "xa", "nb", "xb")
            links = checkpointed(both.mapInArrow(_verified(threshold), "a long, b long, ok boolean")).where("ok").select("a", "b")
        edges = links if edges is None else edges.unionAll(links)
        found = components(edges)
        edges = found.where("v != c").select(F.col("v").alias("a"), F.col("c").alias("b"))  # connects the same
    owned = found.withColumnRenamed("v", "rep").join(reps.select("rep", "own"), "rep")
    named = checkpointed(found.join(owned.groupBy("c").agg(F.min("own").alias("class_id")), "c").select(F.col("v").alias("rep"), "class_id"))
    of = reps.select("ka", "kb", "rep", "own").join(named, "rep", "left").select("ka", "kb", "own", F.coalesce("class_id", "own").alias("class_id"))
    return members.join(checkpointed(of), ["ka", "kb"]).select(F.col("id").alias(id_col), "class_id", F.col("own").alias("rep_id"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its class; rows that share an id stay or go together. Rows without id stay."""
    first = classes(docs, id_col=id_col, text_col=text_col).where(F.col(id_col) == F.col("class_id")).select(id_col).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(first, id_col, "left_semi").select(*docs.columns)
    return named.unionAll(docs.where(F.col(id_col).isNull()))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
