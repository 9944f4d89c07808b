"""Packing along a space-filling curve.

A document's tokens are hashed and projected to a few dimensions; its point gets
a key on a Hilbert curve. Documents are sorted by that key in ranges, and each
range is cut into sequences, so that one sequence holds neighbours on the curve.
Documents are cut where a sequence is full. What is left at the end of a range is
cut into sequences whose lengths are powers of two, which need no padding: no
sequence of this packing is padded.

Copies have one key; document ids part them, so that a group of copies can fill
many ranges. The tokens are computed once and written, as sorting reads its input
twice.

Defined results: a null or empty text is its closing id alone. Rows with a null
id and repeated rows are packed like others. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import batch, blocks_for, distinct_words, mix, utf8
from tideline.session import materialize

LENGTH, CLOSING = 4096, 2
DIMENSIONS, BITS = 3, 16
REMEMBERED = 400_000
#: Fixed values of the vocabulary's file: its pattern of pieces, and the signs that stand for bytes.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
BYTE_SIGNS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
RANGE_TOKENS = 2_000_000  # tokens sorted and packed by one task


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates in [0, 2**bits).

    Skilling's transform: undo the turns of each level from the top, take the
    Gray code across dimensions, then interleave the bits.
    """
    x = points.astype(np.uint32).T.copy()
    dims = len(x)
    level = np.uint32(1 << (bits - 1))
    while level > 1:
        below = np.uint32(level - 1)
        for d in range(dims):
            high = (x[d] & level) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[d]) & below)
            x[0] ^= np.where(high, below, np.uint32(0)) ^ swap
            if d:
                x[d] ^= swap
        level >>= np.uint32(1)
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    level = np.uint32(1 << (bits - 1))
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, np.uint32(level - 1), np.uint32(0))
        level >>= np.uint32(1)
    x ^= turn
    key = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << np.uint64(1) | (x[d] >> np.uint32(b) & np.uint32(1)).astype(np.uint64)
    return key.astype(np.int64)


class WordNumbers(dict):
    """A number for each word met, and the ids of the numbered words one after another (16-bit, as bytes on the way).

    Words of Latin letters go by the vocabulary's own pieces, which recur more than
    words do; others, and words that hold an added token's content, go through all of the tokenizer.
    """

    def __init__(self, tool):
        super().__init__({b"\n": 0})  # the closing id, as a word that no text has
        self.tool, self.pieces = tool, {}
        self.flat, self.sizes = array("H", [CLOSING]), array("i", [1])
        self.uses = np.zeros(1, np.int64)
        self._tokenize = tool.model.tokenize
        self.added = [t.content for t in tool.get_added_tokens_decoder().values()]
        self._sign = {ord(c): self._piece(c) for c in ",."}

    def __missing__(self, word: bytes) -> int:
        if word.isalpha():  # ASCII letters, as most words are
            text = word.lower().decode()
            ids = self.pieces.get(text) or self._piece(text)
        elif word[:-1].isalpha() and word[-1] in b",.":
            text = word[:-1].lower().decode()
            ids = (self.pieces.get(text) or self._piece(text)) + self._sign[word[-1]]
        else:
            ids = self._others(word.decode())
        number = self[word] = len(self.sizes)
        self.sizes.append(len(ids) >> 1)
        self.flat.frombytes(ids)
        return number

    def _others(self, text: str) -> bytes:
        if "<" in text and any(t in text for t in self.added):  # the tokenizer makes one token of each
            return array("H", self.tool.encode(text, add_special_tokens=False).ids).tobytes()
        if text.isascii() or max(text) < "\u0100":
            text = text.lower()
            if text.isalpha():
                return self.pieces.get(text) or self._piece(text)
            if text[:-1].isalpha() and text[-1] in ",.":
                return (self.pieces.get(text[:-1]) or self._piece(text[:-1])) + self._sign[ord(text[-1])]
            return b"".join([self.pieces.get(p) or self._piece(p) for p in PIECES.findall(text)])
        return array("H", self.tool.encode(text, add_special_tokens=False).ids).tobytes()

    def count(self, numbers: np.ndarray) -> None:
        """Take note of words that were used."""
        uses = np.bincount(numbers, minlength=len(self.sizes))
        uses[:len(self.uses)] += self.uses
        self.uses = uses

    def forget(self, most: int) -> None:
        """Keep words used twice since the last time, or more often if these are over ``most``; number them anew."""
        self.count(np.zeros(0, np.int64))
        least, again = 2, self.uses >= 2
        while again.sum() > most:
            least *= 2
            again = self.uses >= least
        again[0] = True
        sizes, flat = np.array(self.sizes, np.int32), np.array(self.flat, np.uint16)
        words = [w for w, kept in zip(self, again.tolist()) if kept]
        self.clear()
        self.update(zip(words, range(len(words))))
        self.pieces.clear()
        self.sizes, self.flat = array("i", sizes[again].tobytes()), array("H", flat[np.repeat(again, sizes)].tobytes())
        self.uses = np.zeros(len(words), np.int64)

    def _piece(self, text: str) -> bytes:
        shown = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(BYTE_SIGNS)
        ids = self.pieces[text] = array("H", [t.id for t in self._tokenize(shown)]).tobytes()
        return ids


class WordTokenizer:
    """Ids of texts, word by word: this vocabulary never joins across ASCII blanks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        size = self.tool.get_vocab_size()
        # each id is hashed to one of 1,024 buckets, each bucket to a direction
        bucket = (mix(np.arange(size, dtype=np.uint64)) % np.uint64(1024)).astype(np.int64)
        self.direction = np.random.default_rng(7).standard_normal((1024, DIMENSIONS)).astype(np.float32)[bucket]
        self.known = WordNumbers(self.tool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the closing id, and where the texts end."""
        if len(self.known) > REMEMBERED:
            self.known.forget(REMEMBERED // 2)
        words, codes, counts = distinct_words(texts)
        closing = np.cumsum(counts + 1) - 1
        numbers = np.zeros(len(codes) + len(counts), np.int64)  # the closing id's, as a start
        numbers[np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)] = np.fromiter(
            map(self.known.__getitem__, words), np.int64, len(words)
        )[codes]
        self.known.count(numbers)
        known, flat = np.array(self.known.sizes, np.int64), np.array(self.known.flat, np.uint16)
        starts, sizes = np.cumsum(known) - known, known[numbers]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(starts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1])] if len(ends) else flat[:0]
        return ids, ends[closing]

    def points(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean direction of each document, on the grid of the curve."""
        if not len(ends):
            return np.zeros((0, DIMENSIONS), np.uint32)
        starts = np.append(0, ends[:-1])
        mean = np.add.reduceat(self.direction[ids], starts, axis=0, dtype=np.float64) / (ends - starts)[:, None]
        return np.clip((np.tanh(4 * mean) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint32)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids, ends = tool.encode(b.column("text"))
                starts = np.append(0, ends[:-1])[:len(ends)]
                raw = ids.astype("<u2").tobytes()
                yield batch(
                    doc_id=b.column("doc_id"), key=pa.array(hilbert_key(tool.points(ids, ends))),
                    tokens=pa.array(ends - starts, pa.int64()),
                    ids=pa.array([raw[2 * x:2 * y] for x, y in zip(starts.tolist(), ends.tolist())], pa.binary()),
                )
    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(length: int, with_ids: bool):
    """Pieces of a range whose documents come in order."""
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence, held, filled = 0, 0, [], 0

        def close(pieces: list[tuple]) -> list[tuple]:
            """Rows of one sequence from its pieces (doc, start, ids, tokens)."""
            nonlocal sequence
            rows, offset = [], 0
            for doc, start, ids, total in pieces:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), total, (part << 33) + sequence, offset, raw))
                offset += len(ids)
            sequence += 1
            return rows

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

        for b in batches:
            rows = []
            for doc, ids, part in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "part"))):
                ids, at = np.frombuffer(ids, "<u2"), 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    held.append((doc, at, ids[at:at + take], len(ids)))
                    at, filled = at + take, filled + take
                    if filled == length:
                        rows += close(held)
                        held, filled = [], 0
            yield emit(rows)
        rows = []
        while filled:  # the rest of the range, by the powers of two in its length
            room, now = 1 << (filled.bit_length() - 1), []
            filled -= room
            while room:
                doc, start, ids, total = held.pop(0)
                now.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    held.insert(0, (doc, start + room, ids[room:], total))
                room -= len(now[-1][2])
            rows += close(now)
        yield emit(rows)
    return run


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = False
) -> DataFrame:
    """Pieces of the sequences; with_ids adds each piece's ids (binary, little-endian 32-bit)."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text"))
    tokens = materialize(source.mapInArrow(_tokenized(path), "doc_id long, key long, tokens long, ids binary"), "tokens")
    ranges = blocks_for(tokens.agg(F.sum("tokens")).first()[0], RANGE_TOKENS)
    ordered = tokens.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    schema = PIECE + ", ids binary" * with_ids
    return ordered.select("doc_id", "ids", F.spark_partition_id().cast("long").alias("part")).mapInArrow(
        _packed(length, with_ids), schema
    )
