"""Operator 13: BPE encoding and decoding through a minimal acyclic transducer.

The corpus' most frequent words (at most WORDS, of at most LONGEST bytes) are counted over all texts, encoded once by
the model's merges and compiled into an automaton that shares suffixes as well as prefixes. Its arcs carry numbers
whose sum along a path is the place of the word, and so of its ids. The automaton is one file of flat arrays in the
shared folder; Spark hands it to every executor, whose workers map it into memory. All words of a block of text walk
through it side by side, one byte a step. A word that it does not hold is merged exactly, pair by pair; so the
automaton decides how fast a word is encoded, never how.

Normalisation and classes of characters are the library's: where Python's tables differ from it (or do not know a
character), the library normalises that piece of text. Special tokens in a text are ids of their own, as in the library.

Null texts count as empty and have no ids. Ids may repeat; ties of counts do not change a result; other columns are not
read; an empty table gives an empty result. A text is worked on in pieces of about PIECE characters, cut at white space,
so memory is that of one text and one piece (a run without white space is one piece).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, checkpointed, mix, powers, prefix_sums, shared_folder, table
from .pieces import model_path, texts_of

#: Words that the automaton holds at most, and bytes of the longest of them: together they bound its size.
WORDS, LONGEST = 1 << 17, 64
#: Characters of a piece of text; words that a task counts before it hands them on; merged words that a worker keeps.
PIECE, COUNTED, MERGED = 1 << 19, 1 << 19, 1 << 18
#: Words of this many bytes and more are merged with a heap.
HEAP_FROM = 48

#: The word pattern of the model family; fixed value, compared with the model's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, OTHER, ODD = 0, 1, 2, 3, 8
CUT = re.compile(r"[ \n\t\r]")


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Model:
    """The vocabulary, merges and special tokens of a tokenizers file of words with ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        norm = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or norm != ["NFC", "Replace", "Lowercase"] or split["pattern"] != {"Regex": PATTERN} or spec["decoder"] or not suffix:
            raise ValueError("only lower-casing BPE models with word ends are supported")
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("special tokens must match as they are")
        ids, chars = model["vocab"], byte_chars()
        self.path = path
        self.inner, self.last = [ids[c] for c in chars], [ids[c + suffix] for c in chars]
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[a] << 32 | ids[b]] = rank << 32 | ids[a + b]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: x for x, i in (ids | self.special).items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of least rank is merged, the leftmost of equals first, until none is left."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        if len(ids) >= HEAP_FROM:
            return self._by_heap(ids)
        ranks = self.ranks
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                r = ranks.get(ids[i] << 32 | ids[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best & 0xFFFFFFFF]
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r & 0xFFFFFFFF, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def classes(self) -> np.ndarray:
        """The class of every code point by the library's tables; ODD added where Python must not normalise it."""
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        out, text, number = np.full(0x110000, OTHER, np.uint8), "".join(chars), np.array(list(map(ord, chars)))
        for kind, name in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
            found = [b for _, (b, _) in Split(Regex(name), "removed", invert=True).pre_tokenize_str(text)]
            out[number[found]] = kind
        norm = self.library.normalizer.normalize_str
        for c in chars[128:]:
            if unicodedata.category(c) == "Cn" or out[ord(c)] != SPACE and norm(c) != lowered(c):
                out[ord(c)] |= ODD
        return out


def lowered(text: str) -> str:
    """NFC and lower case, character by character (Python alone has another sigma at word ends)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=2)
def classes(path: str) -> np.ndarray:
    return model(path).classes()


def automaton(words: list[bytes]) -> tuple[list[bool], list[list[tuple[int, int]]]]:
    """The minimal acyclic automaton of sorted, distinct words: is a state final, and its arcs (byte, target) by byte; state 0 begins."""
    final, arcs, known = [False], [[]], {}
    path = [0]  # the states of the last word, not yet shared
    last = b""

    def share(down_to: int) -> None:
        while len(path) > down_to + 1:
            s = path.pop()
            key = (final[s], *arcs[s])
            same = known.setdefault(key, s)
            if same != s:
                arcs[path[-1]][-1] = (arcs[path[-1]][-1][0], same)
                if s == len(final) - 1:  # the newest: its number can be used again
                    final.pop()
                    arcs.pop()

    for w in words:
        k = 0
        while k < len(last) and k < len(w) and last[k] == w[k]:
            k += 1
        share(k)
        for b in w[k:]:
            final.append(False)
            arcs.append([])
            arcs[path[-1]].append((b, len(final) - 1))
            path.append(len(final) - 1)
        final[path[-1]], last = True, w
    share(0)
    return final, arcs


FIELDS = (("base", np.int32), ("final", np.bool_), ("owner", np.int32), ("target", np.int32), ("number", np.int32), ("begin", np.int32), ("ids", np.int32), ("classes", np.uint8))


def compiled(words: dict[bytes, list[int]], kinds: np.ndarray) -> bytes:
    """One file of arrays: the sizes of all, then each. An arc of state s by byte b is at base[s] + b if owner there is s."""
    order = sorted(words)
    final, arcs = automaton(order)
    below = [0] * len(final)  # words that end at or below a state
    seen, todo = [False] * len(final), [0]
    while todo:  # targets before their sources
        s = todo[-1]
        if seen[s]:
            todo.pop()
            below[s] = below[s] or final[s] + sum(below[t] for _, t in arcs[s])
            continue
        seen[s] = True
        todo += [t for _, t in arcs[s] if not seen[t]]
    size = sum(map(len, arcs)) * 2 + 1024
    owner, target, number = (np.full(size, -1, np.int32) for _ in range(3))
    base, taken, free = np.zeros(len(final), np.int32), bytearray(size), 256
    tried: dict[int, int] = {}  # where the last state of so many arcs found room
    for s in sorted(range(len(final)), key=lambda s: -len(arcs[s])):
        if not arcs[s]:
            continue
        while taken[free]:
            free += 1
        at = free - arcs[s][0][0] if len(arcs[s]) == 1 else max(tried.get(len(arcs[s]), 0), free - 256)
        while True:
            if at + 256 > len(taken):
                taken += bytes(size)  # room for as much again
                owner, target, number = (np.concatenate((x, np.full(size, -1, np.int32))) for x in (owner, target, number))
            if not any(taken[at + b] for b, _ in arcs[s]):
                break
            at += 1
        base[s], place, tried[len(arcs[s])] = at, int(final[s]), at
        for b, t in arcs[s]:
            taken[at + b] = 1
            owner[at + b], target[at + b], number[at + b] = s, t, place
            place += below[t]
    lengths = [len(words[w]) for w in order]
    values = {"base": base, "final": final, "owner": owner, "target": target, "number": number, "begin": np.cumsum([0, *lengths]), "ids": [i for w in order for i in words[w]], "classes": kinds}
    made = [np.asarray(values[n], kind) for n, kind in FIELDS]
    padded = [x.tobytes() + b"\0" * (-x.nbytes % 8) for x in made]
    return np.array([len(x) for x in made], np.int64).tobytes() + b"".join(padded)


class Lexicon:
    """The compiled automaton, mapped into memory, or given as bytes."""

    def __init__(self, source: str | bytes):
        raw = np.memmap(source, np.uint8, "r") if isinstance(source, str) else np.frombuffer(source, np.uint8)
        sizes, at = raw[: 8 * len(FIELDS)].view(np.int64), 8 * len(FIELDS)
        for n, (name, kind) in zip(sizes.tolist(), FIELDS, strict=True):
            n *= np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + n].view(kind))
            at += n + -n % 8

    def find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word data[begin:end], -1 for one that is not held. All words take a step at a time."""
        out = np.full(len(begin), -1, np.int32)
        live, pos, stop = np.arange(len(begin)), begin, end
        state = number = np.zeros(len(begin), np.int32)
        while len(live):
            slot = self.base[state] + data[pos]
            ok = np.flatnonzero(self.owner[slot] == state)
            slot = slot[ok]
            live, stop, pos, number, state = live[ok], stop[ok], pos[ok] + 1, number[ok] + self.number[slot], self.target[slot]
            done = pos == stop
            hit = np.flatnonzero(done & self.final[state])
            out[live[hit]] = number[hit]
            on = np.flatnonzero(~done)
            live, stop, pos, number, state = live[on], stop[on], pos[on], number[on], state[on]
        return out


def cut(text: str, size: int | None = None) -> Iterator[str]:
    """Pieces of about `size` characters; each but the first begins with white space."""
    size, at = size or PIECE, 0
    while len(text) - at > size and (m := CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def word_spans(texts: list[str], m: Model, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the normalised texts, begins and ends of their words there, and the number of words before each text."""
    norm = []
    for x in texts:
        if not x.isascii() and (kinds[np.frombuffer(x.encode("utf-32-le"), np.uint32)] & ODD).any():
            norm.append(m.library.normalizer.normalize_str(x))
        else:
            norm.append(lowered(x))
    whole = "\n".join(norm)
    data = np.frombuffer(whole.encode(), np.uint8)
    chars = data if len(data) == len(whole) else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = kinds[chars] & 7
    n = len(kind)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins |= kind == DIGIT
    gap = begins & (kind == SPACE)
    begins &= kind != SPACE
    at = np.flatnonzero(begins & (chars == 0x27))
    if len(at):  # contractions: an apostrophe that begins a word, then s, t, m, d, re, ve or ll
        one, two = (np.where(at + k < n, chars[np.minimum(at + k, n - 1)], 0) for k in (1, 2))
        long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
        short = np.isin(one, list(b"stmd"))
        begins[at[short | long] + 1] = False
        rest = np.concatenate((at[short] + 2, at[long] + 3))
        rest = rest[rest < n]
        begins[rest[kind[rest] != SPACE]] = True
    bounds = np.append(np.flatnonzero(begins | gap), n)
    first = np.flatnonzero(begins[bounds[:-1]])
    s, e = bounds[first], bounds[first + 1]
    before = np.searchsorted(s, np.cumsum([0, *(len(x) + 1 for x in norm)]))
    if chars is not data:
        width = np.ones(n + 1, np.int64)
        width[1:] += (chars >= 0x80).view(np.int8) + (chars >= 0x800).view(np.int8) + (chars >= 0x10000).view(np.int8)
        width[0] = 0
        off = np.cumsum(width)
        s, e = off[s], off[e]
    return data, s, e, before


class Encoder:
    def __init__(self, m: Model, lexicon: Lexicon):
        self.model, self.lexicon, self.kept = m, lexicon, {}

    def _unseen(self, word: bytes) -> list[int]:
        ids = self.kept.get(word)
        if ids is None:
            ids = self.model.merged(word)
            if len(word) <= LONGEST:
                if len(self.kept) >= MERGED:
                    self.kept.clear()
                self.kept[word] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces without special tokens, and where those of each begin."""
        data, s, e, before = word_spans(texts, self.model, self.lexicon.classes)
        place = self.lexicon.find(data, s, e)
        miss = np.flatnonzero(place < 0)
        raw = data.tobytes() if len(miss) else b""
        extra = [self._unseen(raw[a:b]) for a, b in zip(s[miss].tolist(), e[miss].tolist(), strict=True)]
        begin = self.lexicon.begin
        known = np.maximum(place, 0)
        if not len(begin) - 1:
            length, source = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        else:
            source, length = begin[known].astype(np.int64), (begin[known + 1] - begin[known]).astype(np.int64)
        pool, flat = self.lexicon.ids, np.array([i for x in extra for i in x], np.int32)
        length[miss] = [len(x) for x in extra]
        source[miss] = len(pool) + np.cumsum(length[miss]) - length[miss]
        ends = np.cumsum(length)
        at = np.repeat(source - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        ids = np.concatenate((pool, flat))[at] if len(flat) else pool[at]
        return ids, np.concatenate(([0], ends))[before]

    def documents(self, texts: Iterator[str]) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(number of the text, ids, is this its last part) for parts of texts, in order."""
        held: list[tuple[int, str | int, bool]] = []
        size = 0

        def flush() -> Iterator[tuple[int, np.ndarray, bool]]:
            plain = [x for _, x, _ in held if isinstance(x, str)]
            ids, at = self.encode(plain) if plain else (None, None)
            k = 0
            for n, x, last in held:
                if isinstance(x, str):
                    yield n, ids[at[k] : at[k + 1]], last
                    k += 1
                else:
                    yield n, np.array([x], np.int32), last
            held.clear()

        special = self.model.special
        for n, text in enumerate(texts):
            parts = self.model.special_at.split(text) if self.model.special_at else [text]
            todo = [p for k, x in enumerate(parts) for p in ([special[x]] if k % 2 else cut(x))]
            for k, p in enumerate(todo):
                held.append((n, p, k == len(todo) - 1))
                size += len(p) if isinstance(p, str) else 1
                if size >= PIECE:
                    yield from flush()
                    size = 0
        yield from flush()


@lru_cache(maxsize=2)
def encoder(path: str, name: str) -> Encoder:
    return Encoder(model(path), Lexicon(SparkFiles.get(name)))


def frequent_words(docs: DataFrame, path: str, kinds: np.ndarray, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(word, ids) of at most `words` words that occur twice or more, the most frequent ones, counted over all texts.

    Counts are compared by eighths of octaves: a level that does not fit as a whole is left out.
    """
    flags = docs.sparkSession.sparkContext.broadcast(kinds.tobytes())  # a byte for each code point, whatever the corpus

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kinds, values, seen = model(path), np.frombuffer(flags.value, np.uint8), byte_values(False), Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        def blocks() -> Iterator[list[str]]:
            held, size = [], 0
            for b in batches:
                for text in texts_of(b.column(0)):
                    for p in cut(text):
                        held.append(p)
                        size += len(p)
                        if size >= PIECE:
                            yield held
                            held, size = [], 0
            if held:
                yield held

        for texts in blocks():
            data, s, e, _ = word_spans(texts, m, kinds)
            sums = prefix_sums(data, values)
            short = e - s <= LONGEST
            s, e = s[short], e[short]
            h = mix((sums[e] - sums[s]) * powers(len(sums))[1][s])
            _, first, n = np.unique(h, return_index=True, return_counts=True)  # words of equal hash are counted as one: counts only choose what is compiled
            raw = data.tobytes()
            for a, b, k in zip(s[first].tolist(), e[first].tolist(), n.tolist(), strict=True):
                seen[raw[a:b]] += k
            if len(seen) >= COUNTED:
                yield told()
        if seen:
            yield told()

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = checkpointed(counts.withColumn("level", F.floor(8 * F.log2("n")).cast("int")))
    least, held = None, 0
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("k")).collect(), reverse=True):  # a row for each eighth of an octave
        held += r.k
        if held > words:
            break
        least = r.level
    chosen = counts.where(F.lit(False) if least is None else F.col("level") >= least)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.merged(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["word", "ids"])

    return chosen.select("word").mapInArrow(merge, "word binary, ids array<int>")


def lexicon_file(docs: DataFrame, path: str, text_col: str = "text", words: int = WORDS) -> str:
    """The name under which every executor finds the lexicon of the texts. The file is in the shared folder; its size is bounded by WORDS and LONGEST."""
    kinds, spark = classes(path), docs.sparkSession
    got = frequent_words(docs, path, kinds, text_col, words).toArrow()
    blob = compiled(dict(zip(got["word"].to_pylist(), got["ids"].to_pylist(), strict=True)), kinds)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(at)
    out.write(blob)
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(at).toString())
    return name


def encode(docs: DataFrame, path: str, whole: bool = False, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256. With whole: also the ids and the decoded text."""
    name = lexicon_file(docs, path, text_col, words)
    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, name)
        names = enc.model.names
        for b in batches:
            rows, n, ids_sha, text_sha, kept = [], 0, hashlib.sha256(), hashlib.sha256(), []
            for _, ids, last in enc.documents(texts_of(b.column(1))):
                if len(ids):
                    ids_sha.update(ids.astype("<u4").tobytes())
                    part = b" ".join(map(names.__getitem__, ids.tolist()))
                    text_sha.update(b" " + part if n else part)
                    n += len(ids)
                    if whole:
                        kept.append((ids, part))
                if last:
                    rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest(), [i for x, _ in kept for i in x.tolist()], b" ".join(p for _, p in kept).decode("utf-8", "replace")))
                    n, ids_sha, text_sha, kept = 0, hashlib.sha256(), hashlib.sha256(), []
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 5 if whole else 3]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """rows with the text of the ids: the names of tokens, special ones too, joined by spaces; null for null."""
    names = [x.decode() for x in model(path).names]  # the vocabulary: a fixed size
    given = F.transform(ids_col, lambda i: F.element_at(F.lit(names), i + 1))
    return rows.withColumn(to, F.array_join(given, " "))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path("word_bpe_49k.json"))
