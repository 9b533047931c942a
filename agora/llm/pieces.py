"""Operator 3: SentencePiece encoding and decoding that keeps byte offsets.

Normalisation follows the model's compiled character map: at each byte the
longest key of its double-array trie is replaced, else one character is copied;
spaces become U+2581. For every byte of the normalised text the offset of its
source byte is recorded, and through that record each piece is projected to the
span of original bytes that it covers. The normalised text is cut before each
run of U+2581. No piece reaches over such a cut (checked when the model is
loaded; else the text stays whole), so each part has the pieces it would have in
the whole text, and frequent parts are encoded once per worker.

Null texts count as empty and have no ids. Ids may repeat; other columns are not
read; an empty table gives an empty result. Memory is that of one text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MARK = "▁"
#: Parts kept by a worker, and the longest one kept.
CACHE_PARTS, CACHE_CHARS = 600_000, 48


def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, buf[i : i + n]
        i += n


class CharMap:
    """Longest-prefix replacement by a compiled character map: a trie's size, its 32-bit units, then zero-ended strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key that starts at the offset."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class Encoder:
    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = list(fields(f.read()))
        spec = dict(fields(next((v for k, v in model if k == 3), b"")))
        trainer = dict(fields(next((v for k, v in model if k == 2), b"")))
        self.map = CharMap(spec[2]) if spec.get(2) else None
        self.dummy = bool(spec.get(3, 1)) and not trainer.get(24, 0)
        self.squeeze = bool(spec.get(4, 1))
        if trainer.get(24, 0) or not spec.get(5, 1):
            raise ValueError("models with suffixed or unescaped spaces are not supported")
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.text = [bytes([int(x[3:5], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        self.length = np.array([1 if self.sp.is_byte(i) else len(x.encode()) for i, x in enumerate(names)], np.int64)
        self.marked = np.array([x.startswith(MARK) for x in names])
        falls_back = sum(map(self.sp.is_byte, range(len(names)))) == 256
        self.apart = falls_back and not any(MARK in x.lstrip(MARK) for x in names) and self.dummy and self.map is None and not self.squeeze
        self.mark_id = self.sp.piece_to_id(MARK)
        self.kind = np.uint16 if len(names) <= 1 << 16 else np.uint32
        digits = [f"{i}," for i in range(len(names))]
        self.digits = np.array(digits, f"S{len(digits[-1])}").view(np.uint8).reshape(len(names), -1)
        self.cache: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the offset of its source byte."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int32)
        if self.map is None and not self.squeeze:
            wide = np.where(np.frombuffer(raw, np.uint8) == 0x20, 3, 1)
            align = np.repeat(np.arange(len(raw), dtype=np.int32), wide)
            lead = [0] * (3 * self.dummy)
            return (MARK if self.dummy else "") + text.replace(" ", MARK), np.concatenate((np.array(lead, np.int32), align, np.array([len(raw)], np.int32)))
        return self._mapped(raw)

    def _mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        out, align, i = bytearray(), [], 0
        mark, spaced = MARK.encode(), self.squeeze
        begun = not self.dummy
        while i < len(raw):
            hit = self.map.longest(raw, i) if self.map else None
            if hit is None:
                n = 1
                while i + n < len(raw) and raw[i + n] & 0xC0 == 0x80:
                    n += 1
                hit = (n, raw[i : i + n])
            n, new = hit
            if self.squeeze and spaced:
                new = new.lstrip(b" ")
            if new:
                if not begun:
                    out += mark
                    align += [i] * 3
                    begun = True
                spaced = new.endswith(b" ")
                new = new.replace(b" ", mark)
                out += new
                align += [i] * len(new)
            i += n
        if self.squeeze:
            while out.endswith(mark):
                del out[-3:]
                i = align[-3]
                del align[-3:]
        return out.decode(), np.array([*align, i], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids; the space that stands for the dummy prefix is left out."""
        out = b"".join(map(self.text.__getitem__, ids.tolist()))
        return out[1:] if self.dummy and out[:1] == b" " else out

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        out = self.digits[ids].ravel()
        return out[out != 0][:-1].tobytes()

    def _fill(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts, each without its first space. Plain parts are encoded as one text."""
        made, plain = {}, []
        for x in parts:
            if x and MARK not in x:
                plain.append(x)
            else:
                made[x] = np.array(self.sp.encode(x) or [self.mark_id], self.kind).tobytes()
        if plain:
            ids = np.array(self.sp.encode(" ".join(plain)), self.kind)
            at = np.flatnonzero(self.marked[ids])
            if len(at) != len(plain):
                raise ValueError("a piece reaches over a space")
            raw, w = ids.tobytes(), ids.itemsize
            at = [*(at * w).tolist(), len(raw)]
            made.update((x, raw[s:e]) for x, s, e in zip(plain, at[:-1], at[1:], strict=True))
        return made

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and the end offset in source bytes of each piece."""
        if not text:
            return np.zeros(0, self.kind), np.zeros(0, np.int32)
        norm, align = self.normalise(text)
        if not self.apart:
            return self._whole(text, align)
        if MARK * 2 in norm:
            parts = re.findall(f"{MARK}({MARK}*[^{MARK}]*)", norm)
        else:
            parts = norm.split(MARK)[1:]
        got = list(map(self.cache.get, parts))
        if None in got:
            made = self._fill(list({p for p, g in zip(parts, got, strict=True) if g is None}))
            got = [made[p] if g is None else g for p, g in zip(parts, got, strict=True)]
            if len(self.cache) > CACHE_PARTS:
                self.cache.clear()
            self.cache.update((k, v) for k, v in made.items() if len(k) <= CACHE_CHARS)
        ids = np.frombuffer(b"".join(got), self.kind)
        return ids, align[np.cumsum(self.length[ids])]

    def _whole(self, text: str, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        proto = self.sp.encode(text, out_type="immutable_proto")
        lengths = [1 if self.sp.is_byte(p.id) else len(p.piece.encode()) for p in proto.pieces]
        return np.array([p.id for p in proto.pieces], self.kind), align[np.minimum(np.cumsum(lengths, dtype=np.int64), len(align) - 1)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def texts_of(arr: pa.Array) -> Iterator[str]:
    """Each text; null as empty. One at a time, so that a batch is not held twice."""
    for x in arr.cast(pa.large_binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and the CRC-32 of the piece ends (int32, little-endian).

    With spans: also ids, begins and ends (offsets in the text's UTF-8 bytes) and the decoded text.
    """
    from pyspark.sql import functions as F

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, ends_crc32 long"
    if spans:
        schema += ", ids array<int>, begins array<int>, ends array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            cols: list[list] = [[] for _ in range(9 if spans else 5)]
            for text in texts_of(b.column(1)):
                ids, ends = enc.encode(text)
                decoded = enc.decode(ids)
                row = [len(ids), hashlib.sha256(enc.decimal(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(text.encode()), zlib.crc32(ends.astype("<i4").tobytes())]
                if spans:
                    row += [ids.tolist(), [0, *ends[:-1].tolist()][: len(ends)], ends.tolist(), decoded.decode("utf-8", "replace")]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path())
