"""Byte-level BPE encoding and decoding with a given vocabulary.

A text is cut by the tokenizer's pattern; each piece is merged on its own. The
merges of a piece run on a segment tree over its byte positions, whose nodes hold
the leftmost pair of the smallest rank below them. A merge takes the root's pair,
joins it with its right neighbour and updates the three leaves that changed, so a
piece of n bytes takes O(n log n), however long it is. The trees of short pieces are
worked side by side, as rows of one array. Workers remember the ids of pieces and of what lies between spaces up to
a bound; what is forgotten is merged again.

Documents are independent: batches of texts are encoded where they are read.

Defined results: a null or empty text has no ids and decodes to no bytes. Extra
columns are kept; those named like an output column are replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Numbers that a worker remembers, and pieces merged side by side.
REMEMBERED, TOGETHER = 600_000, 4096
LONG_PIECE = 64  # bytes; longer pieces are merged one by one
NONE = 1 << 62  # above every rank and key


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of the smallest rank until none is left.

    tree[1] is the root, tree[leaves + i] the key of the pair whose left token
    starts at byte i: its rank, then i, so that the position breaks ties.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << (n - 1).bit_length()
    none, get = 1 << 62, ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[leaves + i] = rank * leaves + i
    for k in range(leaves - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    while tree[1] < none:
        i = tree[1] % leaves
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        changed = [(gone, none)]
        for left in (i, before[i]):
            if left >= 0:
                middle = after[left]
                rank = get(piece[left:after[middle]]) if middle < n else None
                changed.append((left, none if rank is None else rank * leaves + left))
        for at, key in changed:
            k = leaves + at
            tree[k] = key
            while k > 1:  # up to the first node that stays as it is
                other = tree[k ^ 1]
                k >>= 1
                if other < key:
                    key = other
                if tree[k] == key:
                    break
                tree[k] = key
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class Pairs:
    """The rank of two neighbouring tokens: a sorted table of all pairs that make up a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        found = [
            (ranks[t[:k]] * self.size + ranks[t[k:]], rank)
            for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        ]
        keys, values = np.array(sorted(found), np.int64).reshape(-1, 2).T
        self.keys, self.values = np.append(keys, -1), np.append(values, NONE)
        self.sorted = self.keys[:-1]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where a pair is no token."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.sorted, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def merge_together(pieces: list[bytes], bytes_to_ids: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some pieces one after another, and how many each has: :func:`merge_piece` on many trees side by side.

    Row r of ``tree`` is the tree of piece r. A round takes the root's pair of every piece that has one.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    leaves = 1 << max(1, int(sizes.max()) - 1).bit_length()
    rows, places = np.arange(len(pieces)), np.arange(leaves)
    alive = places < sizes[:, None]
    token = np.full((len(pieces), leaves + 1), 0, np.int64)
    token[:, :leaves][alive] = bytes_to_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    after, before = (np.tile(np.arange(leaves + 1) + step, (len(pieces), 1)) for step in (1, -1))
    tree = np.full((len(pieces), 2 * leaves), NONE, np.int64)

    def key(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(rank < NONE, rank * leaves + place, NONE)

    r, i = np.nonzero(places + 1 < sizes[:, None])
    tree[r, leaves + i] = key(pairs.ranks(token[r, i], token[r, i + 1]), i)
    half = leaves // 2
    while half:
        tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
        half //= 2
    r = rows[tree[:, 1] < NONE]
    while len(r):
        rank, i = np.divmod(tree[r, 1], leaves)
        gone = after[r, i]
        end = after[r, gone]
        after[r, i], before[r, end], token[r, i], alive[r, gone] = end, i, rank, False
        changed = [(r, gone, np.full(len(r), NONE))]
        inner = end < sizes[r]
        changed.append((r, i, np.where(inner, key(pairs.ranks(rank, token[r, end]), i), NONE)))
        left = before[r, i]
        has = left >= 0
        q, left = r[has], left[has]
        changed.append((q, left, key(pairs.ranks(token[q, left], rank[has]), left)))
        for q, at, value in changed:
            tree[q, leaves + at] = value
        for q, at, _ in changed:
            k = (leaves + at) >> 1
            for _ in range(leaves.bit_length() - 1):
                tree[q, k] = np.minimum(tree[q, 2 * k], tree[q, 2 * k + 1])
                k >>= 1
        r = r[tree[r, 1] < NONE]
    return token[:, :leaves][alive].astype(np.int32), alive.sum(axis=1)


class Encoder:
    """The pattern lets no piece go across a space that follows a non-blank, so texts are
    taken apart there first. What lies between two such spaces (a chunk) and pieces are numbered; ``flat``
    holds the ids of all numbers one after another, from which those of a batch are gathered."""

    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pairs = Pairs(self.ranks)
        self.bytes_to_ids = np.array([self.ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())
        self.pattern = regex.compile(pattern)
        self.odd_blank = regex.compile(r"\s |^ ")
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.flat, self.starts, self.sizes = array("i"), array("q"), array("i")

    def _add(self, ids: Iterable[int], size: int) -> int:
        self.starts.append(len(self.flat))
        self.sizes.append(size)
        self.flat.extend(ids)
        return len(self.sizes) - 1

    def _learn_pieces(self, pieces: Iterable[str]) -> None:
        """Number pieces that are not known."""
        by_leaves: dict[int, list[str]] = {}
        for piece in set(pieces).difference(self.pieces):
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.pieces[piece] = self._add((whole,), 1)
            elif len(raw) > LONG_PIECE:
                ids = merge_piece(raw, self.ranks)
                self.pieces[piece] = self._add(ids, len(ids))
            else:
                by_leaves.setdefault((len(raw) - 1).bit_length(), []).append(piece)
        for group in by_leaves.values():
            for at in range(0, len(group), TOGETHER):
                some = group[at:at + TOGETHER]
                ids, counts = merge_together([p.encode() for p in some], self.bytes_to_ids, self.pairs)
                start = len(self.flat)
                self.flat.frombytes(ids.tobytes())
                first = len(self.sizes)
                self.sizes.extend(counts.tolist())
                self.starts.extend((start + np.cumsum(counts) - counts).tolist())
                self.pieces.update(zip(some, range(first, first + len(some))))

    def _learn_chunks(self, chunks: Iterable[str]) -> None:
        """Number chunks that are not known; one of a single piece shares its number."""
        cut = {c: self.pattern.findall(c) for c in set(chunks).difference(self.chunks)}
        self._learn_pieces(chain.from_iterable(cut.values()))
        for chunk, pieces in cut.items():
            if len(pieces) == 1:
                self.chunks[chunk] = self.pieces[pieces[0]]
            else:
                numbers = [self.pieces[p] for p in pieces]
                ids = array("i")
                for n in numbers:
                    ids.extend(self.flat[self.starts[n]:self.starts[n] + self.sizes[n]])
                self.chunks[chunk] = self._add(ids, len(ids))

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each begins and the last one ends."""
        if len(self.sizes) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self.forget()
        parts: list[list[str]] = []
        plain: list[bool] = []
        for text in texts:
            odd = bool(text) and self.odd_blank.search(text) is not None
            plain.append(not odd)
            if odd:
                parts.append(self.pattern.findall(text))
            else:
                first, *rest = text.split(" ") if text else ("",)
                parts.append([first, *[" " + c for c in rest]] if text else [])
        self._learn_chunks(chain.from_iterable(p for p, ok in zip(parts, plain) if ok))
        self._learn_pieces(chain.from_iterable(p for p, ok in zip(parts, plain) if not ok))
        numbers = np.fromiter(chain.from_iterable(
            map((self.chunks if ok else self.pieces).__getitem__, p) for p, ok in zip(parts, plain)
        ), np.int64)
        sizes = np.array(self.sizes, np.int64)[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        starts = np.array(self.starts, np.int64)[numbers]
        ids = np.array(self.flat, np.int32)[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
        edges = np.append(0, ends)[np.cumsum([0, *map(len, parts)])]
        return ids, edges

    def decode(self, ids: pa.Array, edges: pa.Array) -> pa.Array:
        """The bytes of each run of ids."""
        return pc.binary_join(pa.ListArray.from_arrays(edges, self.tokens.take(ids)), b"")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str) -> Encoder:
    """One per worker process: the vocabulary is read and pieces are remembered once."""
    return Encoder(vocabulary, pattern)


def _mapped(docs: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, column: str, value: Callable) -> DataFrame:
    """Docs with a column computed from another, batch by batch."""
    kept = [c for c in docs.columns if c != name]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):  # bounds what a batch of long texts takes
                part = b.slice(at, 512)
                out = value(part.column(column))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [out.cast(arrow)], names=[*kept, name])
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All rows and columns with ``out``, the array of token ids."""
    def value(texts: pa.Array) -> pa.Array:
        flat, edges = encoder(vocabulary, pattern).encode_all(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32()))
    return _mapped(docs, out, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), text, value)


def decode(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows and columns with ``out``, the bytes of the token ids."""
    def value(column: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        edges = np.append(0, np.cumsum(sizes))
        return encoder(vocabulary, pattern).decode(column.flatten(), pa.array(edges, pa.int32()))
    return _mapped(docs, out, T.BinaryType(), pa.binary(), ids, value)
