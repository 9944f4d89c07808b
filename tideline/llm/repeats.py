"""Removal of byte strings that repeat across documents, on Burrows-Wheeler transforms.

A string of ``length`` bytes is removed wherever a document with a smaller id has
it too. Equal strings are found by threshold-bounded interval expansion: on the
Burrows-Wheeler transform of a set of texts, breadth-first backward extension
sets the longest common prefixes of neighbouring suffixes by increasing value,
and stops at ``length``. Borders that are not set by then lie inside a group of
suffixes that begin with one string.

The transform of a whole corpus would not fit a task, so the corpus is dealt out
by anchors first. Of all strings of 24 bytes inside a string of ``length`` bytes (16
below 40), the one of the smallest hash is its anchor; equal strings have equal anchors.
The strings that follow one another with one anchor form a segment. Anchors of one
document alone are left out; the segments of all others meet by anchor, equal ones
as one, and each set of about a megabyte gets its own transform. An anchor of many
unlike segments (a frequent line with ever other surroundings) is dealt out by whole
strings instead, so that no set grows with it by more than a segment a block.

Blocks and groups send each other a message for each pair of them. Groups hold several
sets in a large corpus, so that messages stand for kilobytes and their number is in
proportion to the input, up to MOST_GROUP; a message costs no step of Python.

Passes, each over blocks of documents in a table bucketed by block, so that texts
are shuffled once: anchors, which are shared, segments, transforms, removal.

Defined results: null and empty texts have no bytes and lose none. A row without
an id counts as after all others; rows of one id do not remove from each other.
Strings shorter than ``length`` and repeats inside one document stay. Columns
named like an output column are replaced; all others are kept. An empty table
gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import blocks_for, keeping_columns, mix
from tideline.session import materialize

LENGTH, ANCHOR = 50, 16
LONG_ANCHOR, LONG_FROM = 24, 40  # in a large corpus most strings of 16 bytes come again somewhere
BLOCK_BYTES, SET_BYTES, ENTRIES = 8 << 20, 1 << 20, 2_000_000
MESSAGE, MOST_GROUP = 4 << 10, 4 << 20  # text for each pair of a block and a group, and for a group at most
SPREAD = 8_000  # unlike segments, besides one a block, from which an anchor is dealt out by whole strings: they would fill a set
LONGEST_RUN = 64
RUN_BITS = np.uint64(20)
SLICE = 1 << 17
LAST = np.iinfo(np.int64).max


def anchor_bytes(length: int) -> int:
    return LONG_ANCHOR if length >= LONG_FROM else ANCHOR


def groups_for(total: int) -> int:
    """Number of groups of sets, of SET_BYTES to MOST_GROUP of text, for messages of MESSAGE where that allows it."""
    return min(blocks_for(total, SET_BYTES), max(blocks_for(BLOCK_BYTES, MESSAGE), blocks_for(total, MOST_GROUP)))


def window_minima(data: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes the smallest hash of the strings of anchor_bytes in it."""
    out = np.zeros(max(0, len(data) - length + 1), np.uint64)
    size = anchor_bytes(length)
    width, words = length - size + 1, range(8, size, 8)
    for at in range(0, len(out), SLICE):
        part = data[at:at + SLICE + length - 1].astype(np.uint64)
        word = part[:-1] | part[1:] << np.uint64(8)
        word = word[:-2] | word[2:] << np.uint64(16)
        word = word[:-4] | word[4:] << np.uint64(32)
        n = len(part) - size + 1
        h = word[:n].copy()
        for k in words:
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h += word[k:k + n]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        span = 1
        while 2 * span <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < width:
            h = np.minimum(h[:len(h) - (width - span)], h[width - span:])
        out[at:at + SLICE] = h[:SLICE]
    return out


class Block:
    """Runs of strings with one anchor in the documents of a block."""

    def __init__(self, texts: list[bytes | None], length: int):
        self.texts = [t or b"" for t in texts]
        self.length = length
        self.data = b"".join(self.texts)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        lasts = ends - (length - 1)  # end of the strings that begin in a document
        minima = window_minima(np.frombuffer(self.data, np.uint8), length)
        cut = np.ones(len(minima), bool)
        cut[1:] = minima[1:] != minima[:-1]
        for marks in (self.starts, lasts):
            cut[marks[(marks >= 0) & (marks < len(cut))]] = True
        begin = np.flatnonzero(cut)
        doc = np.searchsorted(ends, begin, side="right")
        stop = np.append(begin[1:], len(minima))
        good = (begin < lasts[doc]) if len(begin) else np.zeros(0, bool)
        begin, stop, doc = begin[good], stop[good], doc[good]
        pieces = -(-(stop - begin) // LONGEST_RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.begin = np.repeat(begin, pieces) + nth * LONGEST_RUN
        self.stop = np.minimum(self.begin + LONGEST_RUN, np.repeat(stop, pieces))
        # minima crowd at the low end; scrambled, they part evenly. The low bits are left for a run's number
        self.doc, self.anchor = np.repeat(doc, pieces), np.repeat(mix(minima[begin]) >> RUN_BITS << RUN_BITS, pieces)

    def by_anchor(self) -> np.ndarray:
        """Numbers of the runs in order of their anchors, those of one anchor in order of their places."""
        n = len(self.anchor)
        if n >> int(RUN_BITS):
            return np.argsort(self.anchor, kind="stable")
        numbered = self.anchor | np.arange(n, dtype=np.uint64)
        numbered.sort()
        return (numbered & (np.uint64(1) << RUN_BITS) - np.uint64(1)).view(np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and for each 1 if it is in one document of the block, else 1 more than
        it has unlike segments there, up to 255."""
        order = self.by_anchor()
        anchor, doc = taken(self.anchor, order), taken(self.doc, order)
        if not len(anchor):
            return anchor, np.zeros(0, np.uint8)
        new = changes(anchor)
        at, number = np.flatnonzero(new), np.cumsum(new) - 1
        found = np.add.reduceat(new | changes(doc), at, dtype=np.int64)
        several = np.flatnonzero(taken(found > 1, number))
        run = order[several]
        pairs = zip(
            number[several].tolist(), self.begin[run].tolist(), (self.stop[run] + self.length - 1).tolist()
        )
        unlike = {(k, self.data[x:y]) for k, x, y in pairs}
        kinds = np.bincount(np.fromiter((k for k, _ in unlike), np.int64, len(unlike)), minlength=len(found))
        return anchor[at], np.where(found > 1, np.minimum(1 + kinds, 255), 1).astype(np.uint8)

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the runs whose anchors are shared (1) or hot (2), and all codes."""
        order, code = self.by_anchor(), np.zeros(len(self.anchor), np.uint8)
        if len(order):
            code[order] = codes[np.cumsum(changes(taken(self.anchor, order))) - 1]
        return np.flatnonzero(code), code


def bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return (anchors >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


class Numbered(dict):
    """Distinct byte strings, numbered in order of appearance."""

    def __missing__(self, text: bytes) -> int:
        value = self[text] = len(self)
        return value


def _ordered(part: np.ndarray, anchor: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Places of texts by (part, anchor, digest), by their bytes where two digests are equal."""
    digest = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))
    order = np.lexsort((digest, anchor, part))
    same = np.ones(max(0, len(order) - 1), bool)
    for values in (part, anchor, digest):
        same &= values[order[1:]] == values[order[:-1]]
    if same.any():
        rows = list(zip(part.tolist(), anchor.tolist(), digest.tolist(), texts))
        order = np.array(sorted(range(len(texts)), key=rows.__getitem__), np.int64)
    return order


class Segments:
    """Segments of a block: the distinct ones by (set, anchor, bytes), and each place of one."""

    def __init__(self, block: Block, codes: np.ndarray, sets: int):
        runs, code = block.shared(codes)
        begin, stop, doc, anchor = block.begin[runs], block.stop[runs] + block.length - 1, block.doc[runs], block.anchor[runs]
        hot = code[runs] == 2
        if hot.any():  # each string for itself
            sizes = (stop - begin)[hot] - block.length + 1
            nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.repeat(begin[hot], sizes) + nth
            begin = np.append(begin[~hot], at)
            stop = np.append(stop[~hot], at + block.length)
            doc = np.append(doc[~hot], np.repeat(doc[hot], sizes))
            anchor = np.append(anchor[~hot], np.zeros(len(at), np.uint64))
        data, known = block.data, Numbered()
        number = np.fromiter(
            map(known.__getitem__, [data[x:y] for x, y in zip(begin.tolist(), stop.tolist())]), np.int64, len(begin)
        )
        texts = list(known)
        first = np.zeros(len(texts), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        anchor = anchor[first].copy()
        whole = np.flatnonzero(anchor == 0)
        anchor[whole] = np.fromiter((xxhash.xxh3_64_intdigest(texts[k]) for k in whole), np.uint64, len(whole))
        part = bucket_of(mix(anchor), sets)
        order = _ordered(part, anchor, texts)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.texts = [texts[k] for k in order]
        self.part, self.anchor = part[order].astype(np.int64), anchor[order]
        self.number = place[number] if len(number) else number
        self.begin, self.doc = begin, doc


def taken(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """values[places], without a look at the bounds; places beyond them give the last."""
    return np.take(values, places, mode="clip")


def changes(values: np.ndarray) -> np.ndarray:
    """Whether each value is unlike the one before; the first is."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def suffix_order(symbols: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of all suffixes, in order by at least their first ``length`` symbols; also whether a suffix is
    parted from the one before by its first symbols, and how many symbols these are.

    ends: the terminator of each position's text. Prefix doubling, from as many symbols as a
    number holds beside a position. A group of one suffix is in its place and not sorted again.
    """
    n = len(symbols)
    bits, wide = np.uint64(max(1, (n - 1).bit_length())), np.uint64(n.bit_length())
    used = np.flatnonzero(np.bincount(symbols))
    dense = np.zeros(used[-1] + 1, np.uint64)
    dense[used] = np.arange(len(used)) + (used[0] > 0)  # the terminator alone is zero
    left = np.minimum(ends - np.arange(n), length).astype(np.uint8 if length < 256 else np.int64)  # small tables are quick
    width = max(1, int(dense.max()).bit_length())
    first = min((64 - int(bits)) // width, length)
    coded = np.append(taken(dense, symbols), np.zeros(first, np.uint64))
    key = coded[:n].copy()
    for k in range(1, first):
        key <<= np.uint64(width)
        key |= coded[k:k + n]
    short = np.flatnonzero(left < first)  # what lies behind a terminator counts as zeros
    beyond = ((first - left[short].astype(np.int64)) * width).astype(np.uint64)
    key[short] = key[short] >> beyond << beyond
    key <<= bits
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & (np.uint64(1) << bits) - np.uint64(1)).view(np.int64)
    key >>= bits
    new = changes(key)
    parted = new | (taken(left, order) < first)
    rank = np.empty(n, np.int64 if n >> 31 else np.int32)  # where a suffix's group begins, one at least
    head = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    rank[order] = head
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    head = taken(head, open_)
    reach = first
    while reach < length and len(open_):
        at = taken(order, open_)
        tail = taken(rank, at + reach).astype(np.int64)
        tail[taken(left, at) <= reach] = 0
        if 3 * n.bit_length() <= 64:
            packed = head.view(np.uint64)
            packed <<= wide
            packed |= tail.view(np.uint64)
            packed <<= wide
            packed |= at.view(np.uint64)
            packed.sort()
            at = (packed & (np.uint64(1) << wide) - np.uint64(1)).view(np.int64)
            packed >>= wide
            new = changes(packed)
        else:
            by = np.lexsort((at, tail, head))
            at, head, tail = at[by], head[by], tail[by]
            new = changes(head) | changes(tail)
        order[open_] = at
        head = np.maximum.accumulate(np.where(new, open_ + 1, 0))
        rank[at] = head
        more = np.flatnonzero(~(new & np.append(new[1:], True)))
        open_, head = taken(open_, more), taken(head, more)
        reach *= 2
    return order, parted, first


def common_prefix_borders(
    order: np.ndarray, symbols: np.ndarray, is_start: np.ndarray, parted: np.ndarray, first_symbols: int, length: int
) -> np.ndarray:
    """Whether neighbouring suffixes agree on less than ``length`` symbols; one more border at the end.

    Beller, Gog, Ohlebusch and Schnattinger's expansion: an interval of suffixes
    with a common prefix is extended backward by each symbol before it; only an
    extension that sets a new border goes on. order is the suffix array; a suffix
    and the one that begins a symbol earlier give the backward step. It begins with
    the intervals of ``first_symbols`` symbols, whose borders are ``parted``.
    """
    n = len(order)
    row = np.empty(n, np.int64 if n >> 31 else np.int32)
    row[order] = np.arange(n)
    step = taken(row, order - 1)  # row of the suffix one symbol longer
    step[taken(is_start, order)] = -1
    first = taken(symbols, order)
    border = np.append(parted, True)
    low = np.flatnonzero(parted)
    high = np.append(low[1:], n) - 1
    owners = np.full(n, -1, row.dtype)
    for _ in range(length - first_symbols):
        sizes = high - low + 1
        if not len(sizes):
            break
        owner = np.repeat(np.arange(len(low)), sizes)
        to = taken(step, np.arange(len(owner)) + taken(low - (np.cumsum(sizes) - sizes), owner))
        kept = np.flatnonzero(to >= 0)
        to, owner = taken(to, kept).astype(np.int64), taken(owner, kept)
        if not len(to):
            break
        if len(to) > n >> 4:  # in order by a pass over all rows
            owners[to] = owner
            to = np.flatnonzero(owners >= 0)
            owner = taken(owners, to)
            owners[to] = -1
        else:
            by = np.argsort(to)
            to, owner = taken(to, by), taken(owner, by)
        new = changes(owner) | changes(taken(first, to))
        new[1:] |= to[1:] - to[:-1] != 1
        at = np.flatnonzero(new)
        low = taken(to, at)
        high = taken(to, np.append(at[1:], len(to)) - 1)
        fresh = ~taken(border, high + 1)
        low, high = low[fresh], high[fresh]
        border[high + 1] = True
    return border


def first_owners(segments: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes, segment by segment, the smallest owner of an equal one.

    Also how many strings each segment has.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    stops = np.cumsum(sizes + 1) - 1  # terminators
    starts = stops - sizes
    joined = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    symbols = joined.astype(np.uint16) + np.uint16(1)
    symbols[stops] = 0
    ends = np.repeat(stops, sizes + 1)
    is_start = np.zeros(len(symbols), bool)
    is_start[starts] = True
    order, parted, first_symbols = suffix_order(symbols, ends, length)
    border = common_prefix_borders(order, symbols, is_start, parted, first_symbols, length)
    whole = ends - np.arange(len(symbols)) >= length
    owner = np.where(whole, np.repeat(owners, sizes + 1), LAST)
    groups = np.flatnonzero(border[:-1])
    least = np.minimum.reduceat(owner[order], groups)
    found = np.empty(len(symbols), np.int64)
    found[order] = least[np.cumsum(border[:-1]) - 1]
    return found[whole], sizes - length + 1


def runs_of(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal owners inside segments: how many a segment has, their lengths and owners."""
    starts = np.cumsum(counts) - counts
    new = np.append(True, found[1:] != found[:-1])
    new[starts] = True
    at = np.flatnonzero(new)
    return np.add.reduceat(new, starts), np.diff(np.append(at, len(found))), found[at]


# -- the passes ---------------------------------------------------------------------------

ENTRY = "bucket int, block int, low binary, found binary"
CODE = "block int, kind int, part int, a binary, b binary, c binary"
SEGMENT = "part int, block int, anchors binary, sizes binary, owners binary, texts binary"


def joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all rows of a binary column, one after the other, and how many bytes each row has."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    whole = pa.concat_arrays(column.cast(pa.binary()).chunks)
    stops = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset:whole.offset + len(whole) + 1].astype(np.int64)
    return np.frombuffer(whole.buffers()[2] or b"", np.uint8)[stops[0]:stops[-1]].view(kind), np.diff(stops)


def dealt(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of a binary column with so many of the values each."""
    stops = np.append(0, np.cumsum(counts) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(values))])


def stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of equal values begin, and how long they are."""
    at = np.flatnonzero(changes(values))
    return at, np.diff(np.append(at, len(values)))


def _entries(length: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        anchors, found = Block(group.column("_bytes").to_pylist(), length).entries()
        bucket = bucket_of(anchors, buckets)
        at, counts = stretches(bucket)
        return pa.table({
            "bucket": pa.array(bucket[at].astype(np.int32)),
            "block": pa.array(np.full(len(at), group.column("_block")[0].as_py(), np.int32)),
            "low": dealt(anchors, counts), "found": dealt(found, counts),
        })
    return run


def _shared(group: pa.Table) -> pa.Table:
    """Codes for the anchors of a bucket: 0 in one document, 1 shared, 2 hot; sent back to each block."""
    anchors, sizes = joined(group.column("low"), np.uint64)
    found, _ = joined(group.column("found"), np.uint8)
    order = np.argsort(anchors)
    at, counts = stretches(taken(anchors, order))
    found = taken(found, order).astype(np.int64)
    kind = (np.add.reduceat(found, at) >= 2).astype(np.uint8)
    kind += np.add.reduceat(np.maximum(found - 2, 0), at) >= SPREAD
    code = np.empty(len(order), np.uint8)
    code[order] = np.repeat(kind, counts)
    nothing = pa.nulls(group.num_rows, pa.binary())
    return pa.table({
        "block": group.column("block"), "kind": pa.array(np.zeros(group.num_rows, np.int32)), "part": group.column("bucket"),
        "a": dealt(code, sizes // 8), "b": nothing, "c": nothing,
    })


def _replies(replies: pa.Table, kind: int) -> pa.Table:
    return replies.filter(pc.equal(replies.column("kind"), kind)).sort_by("part")


def _codes(replies: pa.Table) -> np.ndarray:
    return joined(_replies(replies, 0).column("a"), np.uint8)[0]


def _owner_ids(group: pa.Table) -> np.ndarray:
    return np.array([LAST if i is None else i for i in group.column("_id").to_pylist()], np.int64)


def _segments(length: int, sets: int):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({n.split()[0]: pa.array([], t) for n, t in zip(SEGMENT.split(", "), [pa.int32()] * 2 + [pa.binary()] * 4)})
        block = Block(group.column("_bytes").to_pylist(), length)
        ids = _owner_ids(group)
        found = Segments(block, _codes(replies), sets)
        owner = np.full(len(found.texts), LAST)
        np.minimum.at(owner, found.number, ids[found.doc])
        sizes = np.fromiter(map(len, found.texts), np.uint16, len(found.texts))
        at, counts = stretches(found.part)
        return pa.table({
            "part": pa.array(found.part[at].astype(np.int32)),
            "block": pa.array(np.full(len(at), group.column("_block")[0].as_py(), np.int32)),
            "anchors": dealt((found.anchor >> np.uint64(32)).astype(np.uint32), counts), "sizes": dealt(sizes, counts), "owners": dealt(owner, counts),
            "texts": dealt(
                np.frombuffer(b"".join(found.texts), np.uint8), np.add.reduceat(sizes, at, dtype=np.int64) if len(at) else at
            ),
        })
    return run


def _transforms(length: int):
    """Smallest owners for the segments of a set, sent back as runs to the blocks they came from."""
    def run(group: pa.Table) -> pa.Table:
        sizes, row_bytes = joined(group.column("sizes"), np.uint16)
        coded = dealt(joined(group.column("texts"), np.uint8)[0], sizes.astype(np.int64)).dictionary_encode()
        texts, number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        owner, anchor = np.full(len(texts), LAST), np.zeros(len(texts), np.uint32)  # half an anchor keeps equal ones together
        np.minimum.at(owner, number, joined(group.column("owners"), np.int64)[0])
        anchor[number] = joined(group.column("anchors"), np.uint32)[0]
        order = np.argsort(anchor, kind="stable")
        texts, owner, anchor = texts.take(pa.array(order)).to_pylist(), owner[order], anchor[order]
        size = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        last = np.append(anchor[1:] != anchor[:-1], True)  # one anchor's segments stay together
        found, begun, done = [], 0, 0
        for at in np.flatnonzero(last).tolist():
            if size[at] - done >= SET_BYTES - (SET_BYTES >> 2) or at + 1 == len(order):
                found.append(first_owners(texts[begun:at + 1], owner[begun:at + 1], length))
                begun, done = at + 1, size[at]
        count, span, first = runs_of(np.concatenate([f for f, _ in found]), np.concatenate([c for _, c in found]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[number]
        n = count[at]
        index = np.repeat((np.cumsum(count) - count)[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        segments = row_bytes // 2
        runs = np.add.reduceat(n, np.cumsum(segments) - segments)
        return pa.table({
            "block": group.column("block"), "kind": pa.array(np.ones(group.num_rows, np.int32)), "part": group.column("part"),
            "a": dealt(n.astype(np.uint16), segments), "b": dealt(span[index].astype(np.uint16), runs),
            "c": dealt(first[index], runs),
        })
    return run


def _removal(length: int, sets: int, columns: list[str], text: str | None):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        texts, ids = group.column("_bytes").to_pylist(), _owner_ids(group)
        block = Block(texts, length)
        marks = np.zeros(len(block.data) + 1, np.int64)
        answers = _replies(replies, 1)
        if answers.num_rows:
            found = Segments(block, _codes(replies), sets)
            count = joined(answers.column("a"), np.uint16)[0].astype(np.int64)
            span = joined(answers.column("b"), np.uint16)[0].astype(np.int64)
            first = joined(answers.column("c"), np.int64)[0]
            start = np.cumsum(count) - count
            before = np.cumsum(span) - span  # strings before a run, from the segment's first on
            before -= np.repeat(before[start], count)
            n = count[found.number]
            index = np.repeat(start[found.number] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            later = first[index] < np.repeat(ids[found.doc], n)
            begin = (np.repeat(found.begin, n) + before[index])[later]
            stop = begin + span[index][later] + length - 1
            marks += np.bincount(begin, minlength=len(marks)) - np.bincount(stop, minlength=len(marks))
        gone = np.cumsum(marks[:-1]) > 0
        kept, removed, n_spans = [], [], []
        for raw, begin in zip(block.texts, block.starts.tolist()):
            lost = gone[begin:begin + len(raw)]
            n_gone = int(lost.sum())
            removed.append(n_gone)
            n_spans.append(int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if n_gone else 0)
            kept.append(np.frombuffer(raw, np.uint8)[~lost].tobytes() if n_gone else raw)
        out = {c: group.column(c) for c in columns}
        if text is not None:  # a character of which a byte is gone goes too
            out[text] = pa.array(
                [None if t is None else k.decode("utf-8", "ignore") for t, k in zip(texts, kept)], pa.string()
            )
        return pa.table(out | {
            "n_bytes": pa.array([len(t) for t in block.texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()), "kept_bytes": pa.array(kept, pa.binary()),
        })
    return run


@keeping_columns("_id", "_bytes", "_block")
def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, rewrite: bool = True
) -> DataFrame:
    """All rows and columns with n_bytes, n_removed, n_spans (maximal removed runs) and kept_bytes.

    With rewrite the text is what is left, without characters that lost a byte.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    spark = docs.sparkSession
    results = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
    columns = [c for c in docs.columns if c not in results and c != text]
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = blocks_for(total, BLOCK_BYTES)
    anchors = 2 * total // (length - anchor_bytes(length) + 2)  # about: of so many places the least begins a run
    buckets, sets = blocks_for(anchors, ENTRIES), groups_for(total)
    name = f"tideline_repeats_{uuid.uuid4().hex}"
    source = docs.select(
        *columns, F.col(key).cast("long").alias("_id"), F.col(text).cast("binary").alias("_bytes"),
        F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int").alias("_block"),
    )
    source.repartition(blocks, "_block").write.option("compression", "zstd").bucketBy(
        blocks, "_block"
    ).saveAsTable(name, format="parquet")
    stored = spark.table(name)
    texts = stored.select("_id", "_bytes", "_block")
    entries = stored.select("_bytes", "_block").groupBy("_block").applyInArrow(_entries(length, buckets), ENTRY)
    codes = materialize(entries.groupBy("bucket").applyInArrow(_shared, CODE), "codes")
    segments = texts.groupBy("_block").cogroup(codes.groupBy("block")).applyInArrow(_segments(length, sets), SEGMENT)
    owners = materialize(segments.groupBy("part").applyInArrow(_transforms(length), CODE), "owners")
    schema = T.StructType(
        [docs.schema[c] for c in columns]
        + ([T.StructField(text, T.StringType())] if rewrite else [])
        + [T.StructField(c, T.LongType()) for c in results[:3]] + [T.StructField("kept_bytes", T.BinaryType())]
    )
    answers = codes.union(owners).groupBy("block")
    return stored.groupBy("_block").cogroup(answers).applyInArrow(
        _removal(length, sets, columns, text if rewrite else None), schema
    )
