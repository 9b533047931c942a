"""Operator 10: benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII characters, with A-Z
lower-cased. Rolling hashes of `min_tile` tokens of every benchmark item are the
seeds; a document that shares seeds with an item is tiled against it: the longest
match of unmarked tokens is marked in both, again and again, while one of at
least `min_tile` tokens is left. An item whose tiles cover `coverage` of its
tokens counts as leaked, in whatever order its passages stand. An item shorter
than `min_tile` must occur as a whole.

No text is shuffled and the documents are read once. The benchmark's seeds go out as
files, one for each block of a fixed number of tokens; tasks map them into memory, so no
task loads them whole, however many there are. Items with equal tokens count
once, under the smallest id. Null, empty and token-free texts and items match nothing;
repeated ids stay, as do null ids. Texts of any length are taken whole; of one only its
tokens' hashes and what it shares with one item at a time are held. Columns of any
other name may be there.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import NOT_ALNUM, column, shared_file, shingles, table, word_hashes

MIN_TILE, COVERAGE = 5, 0.6
#: Benchmark tokens of one index file (24 bytes each).
BLOCK_TOKENS = 2_000_000
#: Lists that make an index, beside the items' ids.
ARRAYS = ("at", "tokens", "lengths", "cut", "seeds", "item", "place")
#: Pairs of positions that a task looks at together.
PAIRS = 1 << 20


def tokens_of(arr: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, token hashes) of each text."""
    for first, at, h in word_hashes(*column(arr), NOT_ALNUM, fold=True):
        for i in range(len(at) - 1):
            yield first + i, h[at[i] : at[i + 1]]


def runs_of(seeds: Iterable[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(begin in a, begin in b, length) of the matches that seeds, equal k-token runs, make: those that follow each other on one diagonal are one."""
    by, out = defaultdict(list), []
    for i, j in seeds:
        by[i - j].append(i)
    for d, at in by.items():
        at.sort()
        begin = last = at[0]
        for i in [*at[1:], None]:
            if i is None or i != last + 1:
                out.append((begin, begin - d, last - begin + k))
                begin = i
            last = i
    return out


def matches(a: np.ndarray, b: np.ndarray, at: np.ndarray, lists: list[np.ndarray], k: int) -> list[tuple[int, int, int]]:
    """The same from places `at` of a and of each the list of places in b that share its seed.

    Only seeds that no other precedes on their diagonal are kept, so a token that is repeated n and m times
    gives n + m matches, not n * m pairs; pairs are looked at some at a time.
    """
    begins, ends = [], []
    n = np.array([len(x) for x in lists])
    total, done = np.cumsum(n), 0
    while done < len(at):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
        i, j = np.repeat(at[done:upto], n[done:upto]), np.concatenate(lists[done:upto])
        first = (i == 0) | (j == 0) | (a[i - 1] != b[j - 1])
        last = (i + k == len(a)) | (j + k == len(b)) | (a[np.minimum(i + k, len(a) - 1)] != b[np.minimum(j + k, len(b) - 1)])
        begins.append(np.stack((i[first], j[first]), 1))
        ends.append(np.stack((i[last], j[last]), 1))
        done = upto
    begin, end = np.concatenate(begins), np.concatenate(ends)
    begin, end = (x[np.lexsort((x[:, 0], x[:, 0] - x[:, 1]))] for x in (begin, end))  # on one diagonal, begins and ends take turns
    return list(zip(begin[:, 0].tolist(), begin[:, 1].tolist(), (end[:, 0] - begin[:, 0] + k).tolist(), strict=True))


def tiled(found: Iterable[tuple[int, int, int]], size_a: int, size_b: int, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from matches (begin in a, begin in b, length): tiles, longest first; ties go to the smallest begins."""
    heap = [(-n, i, j) for i, j, n in found]
    heapq.heapify(heap)
    marked_a, marked_b, out, left = np.zeros(size_a, bool), np.zeros(size_b, bool), [], size_b
    while heap and left >= k:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = marked_a[i : i + n] | marked_b[j : j + n]
        if not taken.any():
            marked_a[i : i + n] = marked_b[j : j + n] = True
            out.append((i, j, n))
            left -= n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([1], taken.astype(np.int8), [1]))))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # what is left unmarked
            if e - s >= k:
                heapq.heappush(heap, (s - e, i + s, j + s))
    return out


def tiles(seeds: Iterable[tuple[int, int]], a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of a against b: (begin in a, begin in b, length), longest first; seeds are equal k-token runs."""
    return tiled(runs_of(seeds, k), len(a), len(b), k)


class Index:
    """Seeds of a block of benchmark items, for each seed length sorted by hash, item and place."""

    def __init__(self, ids: pa.Array, arrays: dict[str, np.ndarray]):
        self.ids = ids
        self.at, self.tokens, self.lengths, self.cut, self.seeds, self.item, self.place = (arrays[name] for name in ARRAYS)

    @classmethod
    def built(cls, ids: pa.Array, tokens: list[np.ndarray], min_tile: int) -> Index:
        by = defaultdict(list)
        for n, h in enumerate(tokens):
            k = min(min_tile, len(h))
            g = shingles(h, k)
            by[k].append((g, np.full(len(g), n, np.int32), np.arange(len(g), dtype=np.int32)))
        parts = []
        for rows in by.values():
            g, n, j = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(g, kind="stable")
            parts.append((g[order], n[order], j[order]))
        ends = lambda sizes: np.cumsum([0, *map(len, sizes)])
        seeds, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        return cls(ids, dict(zip(ARRAYS, (ends(tokens), np.concatenate(tokens), np.array(list(by)), ends(x[0] for x in parts), seeds, item, place), strict=True)))

    def file(self) -> pa.Buffer:
        """The index as an Arrow file of one row, whose columns are lists."""
        cols = {"ids": self.ids} | {name: pa.array(getattr(self, name)) for name in ARRAYS}
        batch = pa.RecordBatch.from_pydict({name: pa.LargeListArray.from_arrays(pa.array([0, len(c)], pa.int64()), c) for name, c in cols.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue()

    @classmethod
    def mapped(cls, path: str) -> Index:
        """The same from such a file, mapped into memory: only the pages that are looked at are loaded, and they can be dropped again."""
        batch = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
        return cls(batch["ids"].values, {name: batch[name].values.to_numpy() for name in ARRAYS})

    def match(self, h: np.ndarray, coverage: float) -> Iterator[tuple[object, int, int, int, float]]:
        """(item, tiles, tokens covered, tokens of the item, coverage) of each item that the text of tokens h leaks."""
        for k, s, e in zip(self.lengths.tolist(), self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True):
            own, g = shingles(h, k), self.seeds[s:e]
            if not len(own):
                continue
            lo = np.searchsorted(g, own, "left")
            hit = np.flatnonzero(g[np.minimum(lo, len(g) - 1)] == own)
            if not len(hit):
                continue
            first, seed = np.unique(lo[hit], return_inverse=True)  # each shared seed once
            by_seed = np.argsort(seed, kind="stable")
            hits = np.split(hit[by_seed], np.cumsum(np.bincount(seed))[:-1])
            n = np.searchsorted(g, g[first], "right") - first
            of = np.repeat(np.arange(len(first)), n)
            span = s + np.arange(len(of)) + np.repeat(first - (np.cumsum(n) - n), n)
            order = np.argsort(self.item[span], kind="stable")  # of each item, its seeds in order, each with its places
            of, items, places = of[order], self.item[span[order]], self.place[span[order]]
            begin = np.flatnonzero(np.diff(items, prepend=-1))
            end = np.append(begin[1:], len(items))
            enough = (end - begin) * k >= coverage * (self.at[items[begin] + 1] - self.at[items[begin]])
            for x, y in zip(begin[enough].tolist(), end[enough].tolist(), strict=True):
                n = int(items[x])
                b, shared = self.tokens[self.at[n] : self.at[n + 1]], np.sort(places[x:y])
                most = np.minimum(np.diff(shared, append=len(b)), k).sum()  # tokens that any shared seed covers
                if most < coverage * len(b):
                    continue
                which, cut = np.unique(of[x:y], return_index=True)
                lists = np.split(places[x:y], cut[1:])
                at = [hits[q] for q in which.tolist()]
                found = tiled(matches(h, b, np.concatenate(at), [p for p, q in zip(lists, at, strict=True) for _ in q], k), len(h), len(b), k)
                covered = sum(t[2] for t in found)
                if covered >= coverage * len(b):
                    yield self.ids[n].as_py(), len(found), covered, len(b), covered / len(b)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, tokens) of items with distinct tokens, in blocks of about `limit` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, h.tobytes()) for i, h in tokens_of(b.column(1)) if len(h)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.binary())], names=["id", "tokens"])

    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(benchmark.dtypes)[id_col]}, tokens binary")
    ids, held, n = [], [], 0
    for r in rows.groupBy("tokens").agg(F.min("id").alias("id")).orderBy("id", "tokens").toLocalIterator():
        ids.append(r.id)
        held.append(np.frombuffer(r.tokens, np.uint64))
        n += len(held[-1])
        if n >= limit:
            yield ids, held
            ids, held, n = [], [], 0
    if held:
        yield ids, held


def index_files(benchmark: DataFrame, min_tile: int, id_col: str, text_col: str, block_tokens: int) -> list[str]:
    """Names of the files, one for each block of the benchmark, that every executor gets; the driver holds one block at a time."""
    spark, kind = benchmark.sparkSession, to_arrow_type(benchmark.schema[id_col].dataType)
    return [shared_file(spark, "benchmark", Index.built(pa.array(ids, kind), tokens, min_tile).file()) for ids, tokens in blocks(benchmark, id_col, text_col, block_tokens)]


def leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, item, n_tiles, n_covered, n_item_tokens, coverage) for each document and item that it leaks; ids of either may be of any type."""
    schema = f"id {dict(docs.dtypes)[id_col]}, item {dict(benchmark.dtypes)[item_col]}, n_tiles int, n_covered int, n_item_tokens int, coverage double"
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = index_files(benchmark, min_tile, item_col, item_text_col, block_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Index.mapped(SparkFiles.get(name)) for name in names]
        for b in batches:
            at, out = [], []
            for i, h in tokens_of(b.column(1)):
                for index in indexes:
                    for row in index.match(h, coverage):
                        at.append(i)
                        out.append(row)
            cols = zip(*out, strict=True) if out else [[]] * 5
            types = [item_kind, pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "item": item_col})


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs that leak no item, with all their columns."""
    at, names = docs.columns.index(text_col), index_files(benchmark, min_tile, item_col, item_text_col, block_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Index.mapped(SparkFiles.get(name)) for name in names]
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, h in tokens_of(b.column(at)):
                keep[i] = not any(True for index in indexes for _ in index.match(h, coverage))
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
