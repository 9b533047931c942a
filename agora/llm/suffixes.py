"""Operator 6: removal of repeated 50-byte strings by bucket-pointer refinement of suffixes.

A byte goes if a string of `length` bytes over it (a window) also starts in a document of
smaller id. Sorting every suffix of the corpus in one place is not needed for that:

1. The texts are packed into compressed blocks, kept in the shared checkpoint folder.
2. Of every window the least hash of its q-grams is its anchor, so equal windows have the
   same anchor at the same place. The windows of one anchor fall into two initial
   buckets: those that hold enough bytes to the right of it, and those that hold enough to the left.
   The string of the anchor and those bytes, 35 or 36 of 50, is the bucket's q-gram.
   Each block sends the hashes of its q-grams, once each with how many different
   contexts it has, and learns which are shared with others.
3. For shared q-grams the bytes of all windows go to the bucket, equal ones of a block once.
   There the bytes decide: equal contexts are one, and the suffixes of what is left
   are sorted by bucket-pointer refinement. Initial buckets are the first 8 bytes; a bucket
   is refined by sorting its suffixes on the bucket pointers of the suffixes that begin where its
   common prefix ends, and the new pointers are used at once by the buckets that follow.
   Neighbours in that order with the same first `length` bytes are equal windows, and
   all go but those of the smallest document.
4. The answers, some bits a context, go back to the blocks, which delete the bytes.

Hashes only bring together what may be equal. A q-gram with more than `small`
different contexts would fill a task: its windows are dealt singly, by the hash of the window, and meet there in
the same way, so the result does not depend on `small`. Every block sends a string once, so a passage that every document holds
costs one row a block. The number of buckets follows the size of the input.

Null texts count as empty, texts below `length` bytes stay whole. Ids are integers; a null id
counts as larger than all others (as 2**63 - 1 does), and rows that share an id never remove each other.
Only the id and the text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, checkpointed, column, mix, powers, prefix_sums, shuffle_partitions, table

LENGTH, GRAM, PIECE = 50, 20, 1 << 18
#: Bytes of text of a block, at least; contexts that a task compares at a time; items that a block handles at a time.
BLOCK_BYTES, CHUNK, ITEMS = 1 << 21, 1 << 13, 1 << 17
#: Different contexts of one q-gram that meet as they are; beyond, its windows are dealt singly.
SMALL = 1000
#: Bytes of text for one bucket, at most, and keys that a task looks at together.
BUCKET_BYTES, KEYS = 1 << 30, 1 << 20
#: How often a block has a q-gram, as far as it counts, and the mark of one that stands in several documents.
OFTEN, OFTEN_DOCS = (1 << 15) - 1, 1 << 15
LOW = np.uint64((1 << 20) - 1)
LOW32 = np.uint64((1 << 32) - 1)
LAST_ID = (1 << 63) - 1

PACKED = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("text", pa.binary())])
PACKED_DDL = "block long, ids array<long>, sizes binary, text binary"
KEYED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("several", pa.binary()), ("times", pa.binary())])
KEYED_DDL = "block long, bucket int, keys binary, several binary, times binary"
SHARED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary())])
SHARED_DDL = "block long, bucket int, n int, shared binary, hot binary"
#: start: the place of the first of the n contexts among those that the part has sent.
#: bucket -1: the plan of n contexts, which passes through to where the answers meet; start: how many of them were sent.
DEALT = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("start", pa.int32()), *((c, pa.binary()) for c in ("keys", "ids", "windows", "text"))])
DEALT_DDL = "block long, part int, bucket int, n int, start int, keys binary, ids binary, windows binary, text binary"
ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("start", pa.int32()), ("answer", pa.binary())])
ANSWER_DDL = "block long, part int, bucket int, n int, start int, answer binary"


def squeezed(raw: np.ndarray | bytes) -> bytes:
    return pa.compress(raw if isinstance(raw, bytes) else raw.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes, n: int, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def parts(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first document, last + 1, begin, end, first and last + 1 window start): texts in groups; a long one in pieces that overlap."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        b, e = int(offsets[i]), int(offsets[j])
        if e - b <= 2 * PIECE - 4 * length:
            yield i, j, b, e, b, e
        else:
            for s in range(b, e, PIECE):
                yield i, j, max(b, s - 2 * length), min(e, s + PIECE + 3 * length), s, min(e, s + PIECE)
        i = j


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(documents, first windows, numbers of windows, q-gram hashes, hashes of the bytes) of all contexts: the windows of an anchor in one of its two buckets."""
    values, w = byte_values(fold=False), length - q + 1
    half = w // 2  # windows that begin up to so many bytes before the anchor are in its right bucket
    for i, j, b, e, first, last in parts(offsets, length):
        n = e - b
        if n < length:
            continue
        sums, back = prefix_sums(data[b:e], values), powers(n + 1)[1]

        def hashed(s: np.ndarray, t: np.ndarray, salt: int, sums=sums, back=back) -> np.ndarray:
            return mix((sums[t] - sums[s]) * back[s] + np.uint64(salt))

        gram = hashed(np.arange(n - q + 1), np.arange(q, n + 1), 0)
        least = (gram & ~LOW) | np.arange(n - q + 1, dtype=np.uint64)
        size = 1
        while size < w:
            step = min(size, w - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        cuts = np.clip(offsets[i : j + 1] - b, 0, n)
        s = np.arange(n - length + 1)
        doc = np.repeat(np.arange(j - i), np.diff(cuts))[: len(s)]
        ok = s + length <= cuts[1:][doc]
        ok[: first - b] = False
        ok[last - b :] = False
        s = s[ok]
        if not len(s):
            continue
        pos = (least[s] & LOW).astype(np.int64)
        left = pos - s > half
        new = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (left[1:] != left[:-1]))))
        start, a, on_left = s[new], pos[new], left[new]
        many = np.diff(np.append(new, len(s)))
        key = hashed(np.where(on_left, a - half - 1, a), np.where(on_left, a + q, a + length - half), 1)
        key ^= on_left.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        yield i + doc[ok][new], start + b, many, key, hashed(start, start + many + length - 1, 2)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> list[np.ndarray]:
    made = list(anchors(data, offsets, length, q))
    if not made:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    return [np.concatenate(c) for c in zip(*made, strict=True)]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(32)).astype(np.int64) * buckets >> 32


def _packed(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            data, offsets = column(b.column(1))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_bytes, "right")) - 1)
                sizes, text = np.diff(offsets[i : j + 1]), data[offsets[i] : offsets[j]]
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, pa.array([sizes.tobytes()], pa.binary()), pa.array([squeezed(text)], pa.binary())], schema=PACKED)
                i, block = j, block + 1

    return run


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes, offsets) of a block."""
    sizes = np.frombuffer(row["sizes"], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.array([LAST_ID if i is None else i for i in row["ids"]], np.int64)
    return ids, unsqueezed(row["text"], int(offsets[-1])), offsets


def distinct(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (bucket, low half) of keys in order, the place of each key, and where each bucket begins."""
    both = bucket_of(key, buckets).astype(np.uint64) << np.uint64(32) | key & LOW32
    every, at = np.unique(both, return_inverse=True)
    return every, at, np.searchsorted(every, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def _keyed(buckets: int, length: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, data, offsets = opened(row)
                doc, _, _, key, same = contexts(data, offsets, length, q)
                order = np.lexsort((same, key))
                new = np.ones(len(key), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | (same[order][1:] != same[order][:-1])
                every, at, cut = distinct(key, buckets)
                first, last = np.empty((2, len(every)), np.int64)
                first[at[::-1]], last[at] = doc[::-1], doc
                times = np.minimum(np.bincount(at[order[new]], minlength=len(every)), OFTEN) + OFTEN_DOCS * (first != last)
                low, several, times = every.astype(np.uint32), times > 1, times.astype(np.uint16)
                out = []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    s, e = cut[k], cut[k + 1]
                    out.append({"block": row["block"], "bucket": k, "keys": low[s:e].tobytes(), "several": np.packbits(several[s:e]).tobytes(), "times": times[s:e][several[s:e]].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=KEYED)

    return run


def ranged(keys: list[np.ndarray], limit: int) -> Iterator[list[tuple[int, int]]]:
    """Ranges of 32-bit keys with about `limit` of them each: where each of the sorted arrays begins and ends in the range."""
    n = max(1, -(-sum(map(len, keys)) // limit))
    bounds = np.array([k * (1 << 32) // n for k in range(n)], np.uint32)
    cuts = [np.append(np.searchsorted(x, bounds), len(x)).tolist() for x in keys]
    for k in range(n) if keys else ():
        yield [(c[k], c[k + 1]) for c in cuts]


def _shared(small: int):
    """Which keys of each row stand elsewhere too, and which of them have more contexts than `small`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
        found = [np.zeros((2, len(k)), bool) for k in keys]
        times = []
        for r, x in zip(rows, keys, strict=True):
            several = np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(x)).astype(bool)
            times.append(np.ones(len(x), np.uint16))
            times[-1][several] = np.frombuffer(r["times"], np.uint16)
        for cut in ranged(keys, KEYS):
            part, n = (np.concatenate([x[s:e] for x, (s, e) in zip(xs, cut, strict=True)]) for xs in (keys, times))
            at = np.unique(part, return_inverse=True)[1]
            shared = (np.bincount(at) + np.bincount(at, n >= OFTEN_DOCS) > 1)[at]
            hot = shared & (np.bincount(at, n & OFTEN) > small)[at]
            done = 0
            for f, (s, e) in zip(found, cut, strict=True):
                f[:, s:e] = shared[done : done + e - s], hot[done : done + e - s]
                done += e - s
        for r, f in zip(rows, found, strict=True):
            if f.any():
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "bucket": r["bucket"], "n": f.shape[1], "shared": np.packbits(f[0]).tobytes(), "hot": np.packbits(f[1]).tobytes()}], schema=SHARED)

    return run


def matrix(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings data[begin:begin + size] as rows, filled up with zeros."""
    wide = np.arange(int(size.max(initial=1)))
    out = np.empty((len(begin), len(wide)), np.uint8)
    for k in range(0, len(begin), 8192):
        b, n = begin[k : k + 8192, None], size[k : k + 8192, None]
        out[k : k + 8192] = np.where(wide < n, data[np.minimum(b + wide, len(data) - 1)], 0)
    return out


def collapsed(rows: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the equal row of the smallest id that stands for it; equality is by the bytes."""
    values, power = byte_values(fold=False), powers(rows.shape[1])[0]
    h = np.concatenate([np.zeros(0, np.uint64), *(mix((values[rows[k : k + 8192]] * power).sum(1, dtype=np.uint64)) for k in range(0, len(rows), 8192))])
    order = np.lexsort((ids, h))
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))[: len(h)]
    to = np.empty(len(h), np.int64)
    to[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    differ = (size[to] != size) | (rows[to] != rows).any(1)
    to[differ] = np.flatnonzero(differ)
    return to


def _dealt(buckets: int, length: int, q: int):
    """Sends the bytes of shared contexts to the bucket of their q-gram, and the block's plan."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row, out = left.to_pylist()[0], []
        ids, data, offsets = opened(row)
        doc, begin, many, key_, _ = contexts(data, offsets, length, q) if right.num_rows else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        every, at, cut = distinct(key_, buckets)
        level = np.zeros((2, len(every)), bool)
        for r in right.to_pylist():
            for f, name in zip(level, ("shared", "hot"), strict=True):
                f[cut[r["bucket"]] : cut[r["bucket"] + 1]] = np.unpackbits(np.frombuffer(r[name], np.uint8), count=r["n"])
        shared, hot = level[:, at]
        on = np.flatnonzero(shared & ~hot)
        single = np.flatnonzero(hot)
        n = many[single]
        doc = np.concatenate((doc[on], np.repeat(doc[single], n)))
        begin = np.concatenate((begin[on], np.repeat(begin[single] - (np.cumsum(n) - n), n) + np.arange(n.sum())))
        many = np.concatenate((many[on], np.ones(int(n.sum()), np.int64)))
        key_ = np.concatenate((key_[on], np.zeros(int(n.sum()), np.uint64)))
        values, power = byte_values(fold=False), powers(length)[0]
        for k in range(len(on), len(doc), 8192):
            key_[k : k + 8192] = mix((values[data[begin[k : k + 8192, None] + np.arange(length)]] * power).sum(1, dtype=np.uint64) + np.uint64(3))
        for part, k in enumerate(range(0, len(doc), ITEMS)):
            d, b, m, g = (x[k : k + ITEMS] for x in (doc, begin, many, key_))
            rows = matrix(data, b, m + length - 1)
            to = collapsed(rows, m, ids[d])
            reps = np.unique(to)
            order = np.lexsort((g[reps] & LOW32, bucket_of(g[reps], buckets)))
            reps = reps[order]
            place = np.empty(len(d), np.int64)
            place[reps] = np.arange(len(reps))
            goes = ids[d] > ids[d[to]]
            plan = (np.diff(b, prepend=0).astype(np.int32), m.astype(np.uint8), np.where(goes, -1, place[to]).astype(np.int32))
            out.append({"block": row["block"], "part": part, "bucket": -1, "n": len(d), "start": len(reps), "text": squeezed(b"".join(x.tobytes() for x in plan))})
            where = bucket_of(g[reps], buckets)
            at_ = np.searchsorted(where, np.arange(buckets + 1))
            for x in np.flatnonzero(np.diff(at_)).tolist():
                r = reps[at_[x] : at_[x + 1]]
                text = rows[r][np.arange(rows.shape[1]) < (m[r] + length - 1)[:, None]]
                out.append({"block": row["block"], "part": part, "bucket": x, "n": len(r), "start": int(at_[x]), "keys": (g[r] & LOW32).astype(np.uint32).tobytes(), "ids": squeezed(ids[d[r]]), "windows": m[r].astype(np.uint8).tobytes(), "text": squeezed(text)})
        return pa.Table.from_pylist(out, schema=DEALT)

    return run


def refined(data: np.ndarray, at: np.ndarray, length: int, chunk: int = 1 << 16) -> np.ndarray:
    """A number for each of the strings of `length` bytes that start at `at`: equal strings have equal numbers.

    Bucket-pointer refinement. suffix: the suffixes in the order found so far; pointer: of each suffix the place where its bucket begins
    there; deep: how many bytes all suffixes of its bucket share. Both are updated bucket by bucket, so what follows sorts on pointers that
    are already finer, and goes deeper at a time. data is padded by 2 * length zeros and more.
    """
    size = len(data) - 8
    if not len(at):
        return np.zeros(0, np.int64)
    eight = np.zeros(size, np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | data[k : k + size]
    suffix = np.argsort(eight)
    new = np.concatenate(([True], eight[suffix][1:] != eight[suffix][:-1]))
    first = np.flatnonzero(new)
    pointer, deep = np.empty(size, np.int64), np.full(size, 8, np.int64)
    pointer[suffix] = first[np.cumsum(new) - 1]
    wanted = np.zeros(size, np.int64)
    wanted[at] = 1

    def open_(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of buckets of `suffix` those that still hold different strings of interest."""
        on = np.flatnonzero((n > 1) & (deep[suffix[begin]] < length))
        begin, n = begin[on], n[on]
        if len(on):
            has = np.add.reduceat(wanted[suffix[spread(begin, n)]], np.cumsum(n) - n) > 0
            begin, n = begin[has], n[has]
        return begin, n

    begin, n = open_(first, np.diff(np.append(first, size)))
    while len(begin):
        left = []
        total, done = np.cumsum(n), 0
        while done < len(begin):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + chunk, "right")))
            b, m = begin[done:upto], n[done:upto]
            places = spread(b, m)
            pos = suffix[places]
            further = np.minimum(pos + deep[pos], size - 1)
            more = deep[pos] + deep[further]
            order = np.argsort(np.repeat(np.arange(len(b)), m) * size + pointer[further])
            pos, far = pos[order], pointer[further[order]]
            new = np.concatenate(([True], far[1:] != far[:-1]))
            new[np.cumsum(m)[:-1]] = True
            starts = places[new]
            suffix[places] = pos
            pointer[pos] = starts[np.cumsum(new) - 1]
            deep[pos] = more[order]
            left.append(open_(starts, np.diff(np.append(np.flatnonzero(new), len(pos)))))
            done = upto
        begin, n = (np.concatenate(x) for x in zip(*left, strict=True))
    order = np.argsort(pointer[at])
    s = at[order]
    same = np.ones(len(s) - 1, bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        same &= eight[s[1:] + k] == eight[s[:-1] + k]
    out = np.empty(len(at), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(~same)))
    return out


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def compared(text: np.ndarray, begin: np.ndarray, many: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each context (text[begin:], of so many windows) the windows, as bits, that a context of a smaller id has too."""
    rows = matrix(text, begin, many + length - 1)
    to = collapsed(rows, many, ids)
    reps = np.unique(to)
    size = (many + length - 1)[reps]
    data = np.concatenate((text[spread(begin[reps], size)], np.zeros(2 * length + 8, np.uint8)))
    at = spread(np.cumsum(size) - size, many[reps])
    own = np.repeat(reps, many[reps])
    bit = spread(np.zeros(len(reps), np.int64), many[reps])
    same = refined(data, at, length)
    least = np.full(int(same.max(initial=-1)) + 1, LAST_ID)
    np.minimum.at(least, same, ids[own])
    out = np.zeros(len(ids), np.int64)
    np.add.at(out, own, (ids[own] > least[same]).astype(np.int64) << bit)
    return np.where(ids > ids[to], (1 << many) - 1, out[to])


def _compared(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] < 0:
                    yield pa.RecordBatch.from_pylist([{"block": r["block"], "part": r["part"], "bucket": -1, "n": r["n"], "start": r["start"], "answer": r["text"]}], schema=ANSWER)
                else:
                    rows.append(r)
        keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
        answers = [np.zeros(len(k), np.uint32) for k in keys]
        for cut in ranged(keys, 16 * CHUNK):
            own, places, part = [], [], [[], [], [], []]
            for x, (r, key, (s, e)) in enumerate(zip(rows, keys, cut, strict=True)):
                if s == e:
                    continue
                many = np.frombuffer(r["windows"], np.uint8).astype(np.int64)
                ends = np.cumsum(many + length - 1)
                text = unsqueezed(r["text"], int(ends[-1]))
                for c, v in zip(part, (key[s:e], unsqueezed(r["ids"], len(key), np.int64)[s:e], many[s:e], text[ends[s] - many[s] - length + 1 : ends[e - 1]]), strict=True):
                    c.append(v)
                own.append(np.full(e - s, x))
                places.append(np.arange(s, e))
            if not own:
                continue
            own, places, (key, ids, many, text) = np.concatenate(own), np.concatenate(places), map(np.concatenate, part)
            size = many + length - 1
            begin = np.cumsum(size) - size
            order = np.lexsort((ids, key))
            new = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            n = np.diff(np.append(new, len(order)))
            several = ids[order[new]] != ids[order[new + n - 1]]  # with one id only, nothing goes
            order, ends = order[np.repeat(several, n)], np.cumsum(n[several])
            done = 0
            while done < len(order):
                upto = int(ends[max(np.searchsorted(ends, done + CHUNK, "right") - 1, np.searchsorted(ends, done, "right"))])
                o, done = order[done:upto], upto
                got = compared(text, begin[o], many[o], ids[o], length)
                for x in np.unique(own[o]).tolist():
                    here = own[o] == x
                    answers[x][places[o[here]]] = got[here]
        for r, a in zip(rows, answers, strict=True):
            if a.any():
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "part": r["part"], "bucket": r["bucket"], "n": r["n"], "start": r["start"], "answer": squeezed(a)}], schema=ANSWER)

    return run


def _applied(length: int, buckets: int, with_text: bool, schema: pa.Schema):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        _, data, offsets = opened(row)
        step = np.zeros(len(data) + 1, np.int32)
        by: dict[int, list[dict]] = {}
        for r in right.to_pylist():
            by.setdefault(r["part"], []).append(r)
        for rows in by.values():
            plan = next(r for r in rows if r["bucket"] < 0)
            n = plan["n"]
            raw = unsqueezed(plan["answer"], 9 * n)
            jump, many, to = (raw[s * n : e * n].view(t) for s, e, t in ((0, 4, np.int32), (4, 5, np.uint8), (5, 9, np.int32)))
            sent = np.zeros(plan["start"] + 1, np.int64)
            for r in rows:
                if r["bucket"] >= 0:
                    sent[r["start"] : r["start"] + r["n"]] = unsqueezed(r["answer"], r["n"], np.uint32)
            bits = np.where(to < 0, (1 << many.astype(np.int64)) - 1, sent[to])
            begin = np.cumsum(jump, dtype=np.int64)
            for k in range(int(many.max(initial=0))):
                s = begin[(bits >> k & 1) == 1] + k
                np.add.at(step, s, 1)
                np.subtract.at(step, s + length, 1)
        gone = np.cumsum(step[:-1]) > 0
        out = []
        edge = np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            g = gone[s:e]
            removed = int(g.sum())
            kept = (data[s:e][~g] if removed else data[s:e]).tobytes()
            out.append((e - s, removed, int(edge[s:e].sum()) + int(removed > 0 and g[0] and not edge[s]), kept if with_text else hashlib.sha256(kept).hexdigest()))
        cols = [pa.array([o[k] for o in out], schema.field(k + 1).type) for k in range(4)]
        return pa.Table.from_arrays([pa.array(row["ids"], pa.int64()), *cols], schema=schema)

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = GRAM, with_text: bool = False, small: int = SMALL) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, and the kept bytes or their SHA-256, of every row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = checkpointed(texts.mapInArrow(_packed(max(BLOCK_BYTES, 512 * buckets)), PACKED_DDL))
    keyed = blocks.mapInArrow(_keyed(buckets, length, q), KEYED_DDL)
    shared = keyed.repartitionById(buckets, F.col("bucket")).mapInArrow(_shared(small), SHARED_DDL)
    dealt = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_dealt(buckets, length, q), DEALT_DDL)
    to = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))
    answers = dealt.repartitionById(buckets, to).mapInArrow(_compared(length), ANSWER_DDL)
    last = ("kept", pa.binary()) if with_text else ("kept_sha256", pa.string())
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), last])
    ddl = f"id long, n_bytes long, n_removed long, n_spans long, {last[0]} {'binary' if with_text else 'string'}"
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_applied(length, buckets, with_text, schema), ddl)
    return out.withColumnRenamed("id", id_col)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
