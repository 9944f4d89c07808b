"""Periodic runs of words, found by exact block convolutions.

A run is a longest stretch of words with smallest period q that repeats at least
four times (and has six words at least). At the scale B, a power of two, the
text is cut into blocks of B words. A run with B <= q < 2B holds a whole block
whose copy q words on lies in the run too, so it is enough to look for each
block's copies at the distances B to 2B - 1. The squared differences of a block
and the window that follows, summed for every distance at once, are one cyclic
convolution of 2B integers, done by a number-theoretic transform modulo a prime:
no rounding, and a sum of zero is a copy. (A sum that the prime divides without
being zero would only seed an extension in vain.) Each distance found seeds an
extension, word by word in doubling steps, to the longest stretch with that period.

Scales are worked through upwards. A block with a word that does not come again
within 2B words has no copy in its window and is not convolved; nor is one whose
window lies inside a run already found, as a larger period of such a stretch is
never its smallest. Texts are worked out one beside the other, some hundred
thousand words at a time, with no shuffle.

Words are what stands between the six ASCII blanks, compared byte by byte.

Defined results: a text that is null, empty or blank has no words and no runs,
and collapses to the empty string. Rows are independent, so repeated rows and
ids give equal results each. All columns of the input are kept, but for columns
named as the results (``n_words``, ``runs``, ``collapsed``), which are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime of the form k * 2^23 + 1, and a generator of its multiplicative group.
PRIME, GENERATOR = 998244353, 3
REPEATS, LEAST = 4, 6
#: Words worked out together, and numbers transformed together.
TOGETHER, NUMBERS = 1 << 18, 1 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


@functools.lru_cache(maxsize=64)
def _powers(size: int, inverse: bool) -> np.ndarray:
    """First ``size`` powers of a root of unity of order ``2 * size``."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * size), PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % np.uint64(PRIME)])
    return out


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below twice the prime, modulo the prime (the smaller ones wrap around to large)."""
    return np.minimum(x, x - np.uint64(PRIME))


def forward(x: np.ndarray) -> np.ndarray:
    """Transform of each row, in bit-reversed order; the length is a power of two."""
    rows, n = x.shape
    p, half = np.uint64(PRIME), n // 2
    while half:
        x = x.reshape(rows, -1, 2, half)
        low, high = x[:, :, 0], x[:, :, 1]
        x = np.stack([_reduced(low + high), (low + p - high) * _powers(half, False) % p], axis=2)
        half //= 2
    return x.reshape(rows, n)


def backward(x: np.ndarray) -> np.ndarray:
    """The rows whose transforms, in bit-reversed order, are given."""
    rows, n = x.shape
    p, half = np.uint64(PRIME), 1
    while half < n:
        x = x.reshape(rows, -1, 2, half)
        low, high = x[:, :, 0], x[:, :, 1] * _powers(half, True) % p
        x = np.stack([_reduced(low + high), _reduced(low + p - high)], axis=2)
        half *= 2
    return x.reshape(rows, n) * np.uint64(pow(n, -1, PRIME)) % p


def copies(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of each block's copies at the distances ``size`` to ``2 * size - 1``.

    ``words`` are numbers below the prime; ``starts + 3 * size`` must lie inside.
    """
    p, found = np.uint64(PRIME), []
    span = np.arange(2 * size)
    for at in range(0, len(starts), max(1, NUMBERS // (2 * size))):
        s = starts[at:at + max(1, NUMBERS // (2 * size))]
        window = words[s[:, None] + size + span].astype(np.uint64)
        block = np.zeros_like(window)
        block[:, :size] = words[s[:, None] + span[:size]]
        squares = np.zeros((len(s), 2 * size + 1), np.uint64)
        np.cumsum(window * window % p, axis=1, out=squares[:, 1:])
        moving = (squares[:, size:2 * size] - squares[:, :size]) % p
        fixed = (block * block % p).sum(axis=1, keepdims=True)
        turned = np.zeros_like(block)
        turned[:, 0], turned[:, 1:] = block[:, 0], block[:, :0:-1]
        product = backward(forward(turned) * forward(window) % p)[:, :size]
        differences = (fixed + moving + np.uint64(2) * (p - product)) % p
        row, distance = np.nonzero(differences == 0)
        found.append((s[row], distance + size))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _reach(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i on (or back) equal those from j on (or back)."""
    n, done, width = len(words), 0, 64
    while True:
        room = min(width, n - j - done if step > 0 else i + 1 - done)
        if room <= 0:
            return done
        if step > 0:
            x, y = words[i + done:i + done + room], words[j + done:j + done + room]
        else:
            x = words[i - done - room + 1:i - done + 1][::-1]
            y = words[j - done - room + 1:j - done + 1][::-1]
        other = x != y
        k = int(other.argmax())
        if other[k]:
            return done + k
        done += room
        width *= 2


@functools.lru_cache(maxsize=4096)
def _factors(n: int) -> tuple[int, ...]:
    """The primes that divide n."""
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return tuple(out + [n] * (n > 1))


def _smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of two periods or more has no smaller period."""
    cycle = words[start:start + period]
    return not any(np.array_equal(cycle, np.roll(cycle, period // f)) for f in _factors(period))


def _covered(starts: np.ndarray, ends: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which intervals lie inside one of the runs."""
    if not runs:
        return np.zeros(len(starts), bool)
    spans = np.array(sorted((s, s + n) for s, n, _ in runs))
    furthest = np.maximum.accumulate(spans[:, 1])
    k = np.searchsorted(spans[:, 0], starts, side="right") - 1
    return (k >= 0) & (furthest[np.maximum(k, 0)] >= ends)


def runs_of(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of numbered words.

    ``words`` may be several texts, each followed by a number of its own;
    ``longest`` is the length of the longest of them.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    again = np.full(n, n, np.int64)
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs: list[tuple[int, int, int]] = []
    size = 1
    while REPEATS * size <= longest:
        whole = len(again) // 2 * 2
        starts = np.flatnonzero(again < 2 * size) * size
        known = len(runs)
        starts = starts[~_covered(starts, starts + 3 * size, runs)]
        if len(starts):
            if starts[-1] + 3 * size > n:
                words = np.concatenate([words, int(words.max()) + 1 + np.arange(3 * size)])
                n = len(words)
            at, distance = copies(words, starts, size)
            keep = ~_covered(at, at + size + distance, runs[:known])
            found: dict[int, int] = {}
            for d, s in sorted(zip(distance[keep].tolist(), at[keep].tolist())):
                if s + size + d <= found.get(d, 0):
                    continue
                on = _reach(words, s, s + d, 1)
                if on < size:
                    continue
                start = s - _reach(words, s - 1, s + d - 1, -1)
                end = s + d + on
                found[d] = end
                if end - start >= max(LEAST, REPEATS * d) and _smallest(words, start, d):
                    runs.append((start, end - start, d))
        again = again[:whole].reshape(-1, 2).max(axis=1)
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, and where each text's words begin and end among them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # leaves empty strings at the edges
    words = lists.flatten()
    real = pc.not_equal(words, "")
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return words.filter(real), before[edges]


def runs_together(words: pa.Array, edges: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs of each of some texts, which are given as by :func:`split`."""
    texts, sizes = len(edges) - 1, np.diff(edges)
    if not sizes.any():
        return [[] for _ in range(texts)]
    coded = words.slice(int(edges[0]), int(edges[-1] - edges[0])).dictionary_encode()
    numbers = np.empty(len(coded) + texts, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    numbers[np.arange(len(coded)) + np.repeat(np.arange(texts), sizes)] = coded.indices.to_numpy()
    numbers[ends] = len(coded.dictionary) + np.arange(texts)  # no word, so nothing repeats across it
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
    runs = runs_of(numbers, int(sizes.max()))
    owner = np.searchsorted(ends, [r[0] for r in runs], side="right").tolist()
    for k, (start, length, period) in zip(owner, runs):
        out[k].append((start - int(ends[k] - sizes[k]), length, period))
    return out


def collapse(words: pa.Array, edges: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    """Each text's words that no run repeats, joined by single blanks."""
    change = np.zeros(len(words) + 1, np.int32)
    for begin, found in zip(edges.tolist(), runs):
        for start, length, period in found:
            change[begin + start + period] += 1
            change[begin + start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    before = np.concatenate([[0], np.cumsum(kept)])
    lists = pa.ListArray.from_arrays(pa.array(before[edges], pa.int32()), words.filter(pa.array(kept)))
    return pc.binary_join(lists, " ")


def _worked(batches: Iterator[pa.RecordBatch], text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for b in batches:
        words, edges = split(b.column(text))
        runs, begin = [], 0
        while begin < len(b):
            end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + TOGETHER)))
            runs += runs_together(words, edges[begin:min(end, len(b)) + 1])
            begin = end
        flat = [r for each in runs for r in each]
        starts, lengths, periods = zip(*flat) if flat else ((), (), ())
        items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], fields=list(kind))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
        columns = [b.column(i) for i, name in enumerate(b.schema.names) if name != text]
        columns += [
            pa.array(np.diff(edges), pa.int64()),
            pa.ListArray.from_arrays(offsets, items),
            collapse(words, edges, runs),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)


def periodic_runs(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the text without repeats.

    A run is (start, length, period), counted in words from 0. A word is
    left out of ``collapsed`` if some run holds it after that run's first period.
    """
    results = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c not in results and (keep_text or c != text)]
    private = "_words_of_" + "_".join(docs.columns)  # longer than any column's name, so not one of them
    sent = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(private))
    names = [*kept, *results]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields if f.name != private)
    schema += f"{', ' if schema else ''}n_words bigint, runs {RUNS}, collapsed string"
    return sent.mapInArrow(lambda batches: _worked(batches, private, names), schema)
