"""Language-model scores: a hashed maximum-entropy model over word classes and words.

P(word | context) = P(class | context) * P(leaf | class, context) * P(word | leaf).
The class of the next word is a softmax over 32 classes. Inside its class the word
is chosen by the binary decisions on the way to its leaf, given by up to 10 bits of
its hash; each decision is a logistic model around the log odds of the tokens on
either side. The features of both are the last word, the last two as a pair, and the
words two and three back (skips), hashed to weight rows; a row of the decisions
belongs to a feature and the five decisions below one node. The number of decisions
and of rows grows with the counted vocabulary, up to 32 * 2**10 leaves and 16,384
rows of each kind. Only words that share a leaf are parted by their smoothed
counts alone. Words without a training token are one word, in a leaf of class 0.
Classes come from the corpus: the signs of five random projections of a word's
neighbours, so words that occur in like surroundings share a class.

Passes, none of which gathers the corpus: texts are numbered by words per unit
(about one read task), the units' vocabularies are counted by word, the counts go
back to the units, which become columns of small integers; gradient updates run
over these where they lie, every training token once per fit, in two halves of
the documents. A task starts from the common weights, steps through its documents,
and the rows of weights it touched are averaged by how often they were used.
Scoring reads the same columns in sparse numpy batches.

A base score is kept beside: the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))).

Tokens are the words of the text, A-Z lower-cased, then one end.

Defined results: null and empty texts are their end alone. Documents without an id
are training documents. Repeated rows count, and are scored alike. An empty table
gives an empty result. Only the id and the results are returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tideline.llm.common import distinct_words, mix, utf8
from tideline.session import materialize

CLASSES, SIGNS, ROWS = 32, 5, 1 << 13
FORK, MOST_LEVELS, MOST_ROWS = 5, 2, 1 << 14  # decisions a row of weights holds, such rows on a word's way, rows
NOTHING = 1e-3  # tokens that an empty side of a decision counts for
UNKNOWN = CLASSES  # stands for the class of a word without a training token
HALVES, STEP, RATE = 2, 4096, 0.2
SPAN = 1 << 15  # weights moved side by side
FEW = 8  # rows of weights met so often in a step are summed side by side
END = b"\n"
UNIT_BYTES = 32 << 20
SMOOTH = 0.1

_projection = (np.random.default_rng(11).integers(0, 2, (4096, SIGNS)) * 2 - 1).astype(np.int8)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


NUMBERED = "unit long, id long, held boolean, words binary, number int, word binary, n long" + "".join(
    f", s{k} long" for k in range(SIGNS)
)


def _new_unit() -> int:
    return uuid.uuid4().int >> 65


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units: rows of documents (words) and rows of their vocabulary (number, word, counts)."""
    def documents(unit: int, ids, held, texts) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([
            pa.array([unit] * n), pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(texts, pa.binary()),
            pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *[pa.nulls(n, pa.int64())] * (1 + SIGNS),
        ], names=[x.split()[0] for x in NUMBERED.split(", ")])

    def vocabulary(unit: int, words: pa.Array, training: list[np.ndarray]) -> pa.RecordBatch:
        n = len(words)
        counts, sums = np.zeros(n, np.int64), np.zeros((SIGNS, n), np.int64)
        signs = np.ascontiguousarray(_projection[(_hashes(words.to_pylist()) % np.uint64(4096)).astype(np.int64)].T)
        for at in range(0, len(training), 256):  # bounds the temporary arrays
            numbers = np.concatenate(training[at:at + 256]).astype(np.int64)
            np.add.at(counts, numbers, np.ones(len(numbers), np.int64))
            for k in range(SIGNS):
                own = np.take(signs[k], numbers)
                around = np.zeros(len(own), np.int64)
                around[:-1] += own[1:]
                around[1:] += own[:-1]
                np.add.at(sums[k], numbers, around)
        return pa.RecordBatch.from_arrays([
            pa.array([unit] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()),
            pa.array(np.arange(n, dtype=np.int32)), words, pa.array(counts), *map(pa.array, sums),
        ], names=[x.split()[0] for x in NUMBERED.split(", ")])

    def unit_of(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        unit, training = _new_unit(), []
        found = pa.chunked_array([pa.array([END]), *(words for _, _, words, _, _ in parts)]).dictionary_encode()
        for (ids, held, _, codes, counts), numbered in zip(parts, found.chunks[1:]):
            numbers = np.zeros(len(codes) + len(counts), np.uint32)  # the end is number 0
            places = np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)
            numbers[places] = numbered.indices.to_numpy()[codes]
            each = np.split(numbers, np.cumsum(counts + 1)[:-1])
            training += [x for x, out in zip(each, held) if not out]
            yield documents(unit, ids, held, [x.tobytes() for x in each])
        yield vocabulary(unit, found.chunks[-1].dictionary, training)

    parts, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            texts = part.column("text")
            words, codes, counts = distinct_words(pc.ascii_lower(texts.view(pa.string())).view(pa.binary()))
            parts.append((
                part.column("id").to_pylist(), part.column("held").to_pylist(), pa.array(words, pa.binary()), codes, counts
            ))
            size += pc.sum(pc.binary_length(texts)).as_py() or 0
            if size >= UNIT_BYTES:
                yield from unit_of(parts)
                parts, size = [], 0
    if parts:
        yield from unit_of(parts)


CODED = (
    "id long, held boolean, n_tokens long, n_known long, base double, inside double, hashes binary, classes binary"
)


class Shape:
    """Sizes of a model, from the number of its words."""

    def __init__(self, words: int):
        self.levels = next((k for k in range(1, MOST_LEVELS) if CLASSES << FORK * k >= words), MOST_LEVELS)
        self.bits = FORK * self.levels
        self.rows = min(max(ROWS, 1 << max(words - 1, 0).bit_length()), MOST_ROWS)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Leaves of words inside their class, by their 16-bit hash."""
        return hashes.astype(np.int64) >> (16 - self.bits)


def decision_odds(mass: np.ndarray) -> np.ndarray:
    """Log odds of the right side at each node (class, heap number), from the tokens of the leaves (class, leaf)."""
    leaves = mass.shape[1]
    odds = np.zeros((CLASSES, leaves), np.float32)
    while leaves > 1:
        left, right = mass[:, ::2], mass[:, 1::2]
        leaves >>= 1
        odds[:, leaves:2 * leaves] = np.log((right + NOTHING) / (left + NOTHING))
        mass = left + right
    return odds


def _coded(shape: Shape, totals: dict, mass: np.ndarray):
    """Documents of a unit as hashes and classes of their words, with what needs counts summed."""
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        n = words.num_rows
        count, kind, hashed = np.zeros(n, np.int64), np.zeros(n, np.uint8), np.zeros(n, np.uint16)
        if n:
            at = words.column("number").to_numpy()
            count[at], kind[at] = words.column("c").to_numpy(), words.column("class").to_numpy()
            hashed[at] = words.column("h").to_numpy()
        base = np.log10((count + SMOOTH) / (totals["n"] + SMOOTH * (totals["v"] + 1)))
        leaf = np.where(count > 0, mass[kind, shape.codes(hashed)], mass[0, 0])
        inside = np.log10((count + SMOOTH) / leaf)
        kind[count == 0] = UNKNOWN
        known, bytes_of = count > 0, {"hashes": [], "classes": []}
        n_tokens, n_known = np.zeros((2, docs.num_rows), np.int64)
        sums = np.zeros((2, docs.num_rows))
        texts = docs.column("words").to_pylist()
        for at in range(0, len(texts), 64):
            some = texts[at:at + 64]
            sizes = np.array([len(x) // 4 for x in some])  # the end is in every one
            starts = np.cumsum(sizes) - sizes
            x = np.frombuffer(b"".join(some), np.uint32).astype(np.int64)
            within = slice(at, at + len(some))
            n_tokens[within] = sizes
            n_known[within] = np.add.reduceat(known[x], starts, dtype=np.int64)
            sums[0, within], sums[1, within] = np.add.reduceat(base[x], starts), np.add.reduceat(inside[x], starts)
            for name, values in (("hashes", hashed[x]), ("classes", kind[x])):
                bytes_of[name] += [v.tobytes() for v in np.split(values, starts[1:])]
        return pa.table({
            "id": docs.column("id"), "held": docs.column("held"), "n_tokens": n_tokens, "n_known": n_known,
            "base": sums[0], "inside": sums[1], **{name: pa.array(v, pa.binary()) for name, v in bytes_of.items()},
        })
    return run


def context_features(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The four features of each token, hashed, given where documents start."""
    n, numbered = len(hashes), hashes.astype(np.uint64) + np.uint64(1)
    ends = np.append(starts, n)[1:]

    def back(k: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[k:] = numbered[:max(n - k, 0)]
        for first in range(k):  # the first words of a document have none so far back
            at = starts + first
            out[at[at < ends]] = 0
        return out

    one, two, three = back(1), back(2), back(3)
    out = np.empty((4, n), np.uint64)
    for at in range(0, n, STEP):
        part = slice(at, at + STEP)
        features = one[part], one[part] * np.uint64(70_001) + two[part], two[part], three[part]
        for k, f in enumerate(features):
            out[k, part] = mix(f * np.uint64(4) + np.uint64(k))
    return out


def class_log_odds(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probability of each class for each token; those of one class lie side by side."""
    taken = np.take(weights, rows[0], axis=0, mode="clip")
    out = taken + bias
    for row in rows[1:]:
        np.take(weights, row, axis=0, mode="clip", out=taken)
        out += taken
    out = np.ascontiguousarray(out.T)
    out -= out.max(axis=0)
    sums = np.exp(out)
    while len(sums) > 8:  # eighths, then neighbours, as sum adds up the classes of one token
        sums = np.concatenate([sums[:8] + sums[8:16], sums[16:]])
    while len(sums) > 1:
        sums = sums[::2] + sums[1::2]
    out -= np.log(sums)
    return out.T


class Decisions:
    """The decisions inside the classes on the way to some tokens' words."""

    def __init__(self, shape: Shape, odds: np.ndarray, features: np.ndarray, classes: np.ndarray, codes: np.ndarray):
        n, classes = len(codes), classes.astype(np.int64)
        self.rows = np.empty((len(features), shape.levels, n), np.int64)
        self.within, self.size = np.empty((shape.levels, n), np.int64), shape.rows
        self.places = np.empty((len(features), shape.levels, n), np.int64)
        self.known, self.right = np.empty((2, FORK, shape.levels, n), np.float32)
        heap, first = codes | 1 << shape.bits, classes << shape.bits
        for level in range(shape.levels):
            above = codes >> (shape.bits - FORK * level)
            group = (classes << shape.bits | above) * MOST_LEVELS + level + 1
            salt = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for f, own in enumerate(features):
                np.bitwise_and(mix(own + salt).view(np.int64), shape.rows - 1, out=self.rows[f, level])  # a power of two
            self.within[level] = codes >> (shape.bits - FORK * (level + 1)) & ((1 << FORK) - 1)
            for k in range(FORK):
                node = heap >> (shape.bits - FORK * level - k)
                self.known[k, level] = np.take(odds, first + node, mode="clip")
                self.right[k, level] = heap >> (shape.bits - 1 - FORK * level - k) & 1

    def log_odds(self, weights: np.ndarray, k: int) -> np.ndarray:
        """Log odds of the right side of the k-th decisions, by level and token, from the weights of all of these.

        The places of their weights are kept until the next call, by feature, level and token.
        """
        columns = (self.within >> (FORK - k)) * self.size
        taken = np.empty(columns.shape, weights.dtype)
        for f, place in enumerate(self.places):
            np.add(self.rows[f], columns, out=place)
            np.take(weights, place, mode="clip", out=taken)
            out = out + taken if f else taken.copy()
        out += self.known[k]
        return out

    def log_probability(self, weights: np.ndarray) -> np.ndarray:
        """Log probability of each token's leaf inside its class; weights lie as by_decision has them."""
        total = 0
        for k in range(FORK):
            taken = self.log_odds(weights[self.size << k:], k)
            taken *= 2 * self.right[k] - 1
            out = np.minimum(taken, 0)
            np.abs(taken, out=taken)
            np.negative(taken, out=taken)
            np.exp(taken, out=taken)
            out -= np.log1p(taken, out=taken)
            total = total + out.sum(axis=0, dtype=np.float64)
        return total


def by_decision(weights: np.ndarray) -> np.ndarray:
    """Rows of decisions by column: those of k-th decisions side by side, from the number of rows << k on."""
    return np.ascontiguousarray(weights.T).ravel()


def sums_by_key(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (below 2**16), how often each occurs, and the sums of its values' rows.

    Keys may go through the rows of values several times. Keys that occur up to FEW times are
    summed side by side, in the order that reduceat sums the others.
    """
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    taken = keys[order]
    begins = np.flatnonzero(np.append(True, taken[1:] != taken[:-1])[:len(taken)])
    times = np.diff(np.append(begins, len(taken)))
    few = np.minimum(times, FEW + 1)
    by = np.argsort((FEW + 1 - few).astype(np.uint8), kind="stable")  # sorted by radix
    begins, times = begins[by], times[by]
    order = np.take(np.tile(np.arange(len(values)), len(keys) // max(len(values), 1)), order, mode="clip")
    sums = np.take(values, order[begins], axis=0, mode="clip")
    *met, many = (len(few) - np.cumsum(np.bincount(few, minlength=FEW + 2)))[:FEW + 1].tolist()
    rest = np.take(values, order[begins[many:met[1]] + 1], axis=0, mode="clip")  # all but the first, then the first
    for k in range(2, FEW):
        rest[:met[k] - many] += np.take(values, order[begins[many:met[k]] + k], axis=0, mode="clip")
    sums[many:met[1]] += rest
    if many:
        starts = np.cumsum(times[:many]) - times[:many]
        places = np.arange(times[:many].sum()) + np.repeat(begins[:many] - starts, times[:many])
        sums[:many] = np.add.reduceat(np.take(values, order[places], axis=0, mode="clip"), starts, axis=0)
    return taken[begins], times, sums


def _targets(shape: Shape, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and leaf of each token."""
    unknown = classes == UNKNOWN
    return np.where(unknown, 0, classes), np.where(unknown, 0, shape.codes(hashes))


def _documents(b: pa.RecordBatch, wanted: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, classes and starts of the wanted documents of a batch."""
    hashes = [h for h, w in zip(b.column("hashes").to_pylist(), wanted) if w]
    classes = [c for c, w in zip(b.column("classes").to_pylist(), wanted) if w]
    sizes = np.array([len(c) for c in classes], np.int64)
    return np.frombuffer(b"".join(hashes), np.uint16), np.frombuffer(b"".join(classes), np.uint8), np.cumsum(sizes) - sizes


def _updates(shape: Shape, weights: np.ndarray, bias: np.ndarray, odds: np.ndarray):
    """Gradient steps of a task from the common weights; returns the rows it used, with their use."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shape.rows
        own, seen, used = weights[:n].copy(), np.full(n, 1e-2, np.float32), np.zeros(2 * n, np.int64)
        forks, fork_seen = by_decision(weights[n:]), np.full(n << FORK, 1e-2, np.float32)
        total, turns_of, squares_of = np.zeros(n << FORK), np.empty(SPAN, np.float32), np.empty(SPAN, np.float32)
        row, gradient = np.zeros(0, np.int64), np.zeros((0, CLASSES), np.float32)

        def move_classes() -> None:
            for low in range(0, len(row), 4096):
                rows, turns = row[low:low + 4096], gradient[low:low + 4096]
                known = np.add.reduce(turns * turns, axis=1)
                known /= CLASSES
                known += seen[rows]
                seen[rows] = known
                turns *= RATE
                turns /= np.sqrt(known)[:, None]
                own[rows] = np.take(own, rows, axis=0, mode="clip") - turns

        def move_decisions(k: int) -> None:
            for low in range(n << k, n << k + 1, SPAN):  # most rows are met in a step, so all are worked
                near_by = slice(low, min(low + SPAN, n << k + 1))
                turn, spread = turns_of[:near_by.stop - low], squares_of[:near_by.stop - low]
                turn[:] = total[near_by]
                total[near_by] = 0
                np.multiply(turn, turn, out=spread)
                fork_seen[near_by] += spread
                np.sqrt(fork_seen[near_by], out=spread)
                np.multiply(turn, RATE, out=turn)
                np.divide(turn, spread, out=turn)
                forks[near_by] -= turn

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                hashes, classes, starts = _documents(b, [True] * b.num_rows)
                features = context_features(hashes, starts)
                classes, codes = _targets(shape, hashes, classes)
                for at in range(0, len(classes), STEP):  # moves by the last step first: its weights are then close by
                    part = slice(at, at + STEP)
                    move_classes()
                    near = (features[:, part] & np.uint64(n - 1)).astype(np.int64)
                    slope = class_log_odds(own, bias, near)
                    np.exp(slope, out=slope)
                    slope[np.arange(slope.shape[0]), classes[part]] -= 1
                    row, times, gradient = sums_by_key(np.ascontiguousarray(slope), near.ravel())
                    used[row] += times
                    ways = Decisions(shape, odds, features[:, part], classes[part], codes[part])
                    for k in range(FORK):  # the k-th decisions have their own weights
                        move_decisions(k)
                        theirs, their_total = forks[n << k:n << k + 1], total[n << k:n << k + 1]
                        fork_slope = ways.log_odds(theirs, k)
                        np.negative(fork_slope, out=fork_slope)
                        np.exp(fork_slope, out=fork_slope)
                        fork_slope += 1
                        np.divide(1, fork_slope, out=fork_slope)
                        fork_slope -= ways.right[k]
                        fork_slope = fork_slope.astype(np.float64).ravel()
                        for place in ways.places:  # of each feature
                            np.add.at(their_total, place.ravel(), fork_slope)
                    used[n:] += np.bincount(ways.rows.ravel(), minlength=n)
        move_classes()
        for k in range(FORK):
            move_decisions(k)
        own = np.concatenate([own, forks.reshape(-1, n).T])
        row = np.flatnonzero(used)
        ends = np.arange(0, CLASSES * len(row) + 1, CLASSES, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.array(row.astype(np.int32)), pa.array(used[row]),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(own[row].astype(np.float32).ravel())),
        ], names=["row", "used", "weights"])
    return run


def _scored(shape: Shape, weights: np.ndarray, bias: np.ndarray, odds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, forks = weights[:shape.rows], by_decision(weights[shape.rows:])
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                hashes, classes, starts = _documents(b, [True] * b.num_rows)
                features, chosen = context_features(hashes, starts), np.zeros(len(classes))
                classes, codes = _targets(shape, hashes, classes)
                for at in range(0, len(classes), STEP):
                    part = slice(at, at + STEP)
                    near = features[:, part]
                    by_class = class_log_odds(own, bias, (near & np.uint64(shape.rows - 1)).astype(np.int64))
                    chosen[part] = by_class[np.arange(len(by_class)), classes[part]]
                    chosen[part] += Decisions(shape, odds, near, classes[part], codes[part]).log_probability(forks)
                outside = np.add.reduceat(chosen, starts) / np.log(10) if len(starts) else np.zeros(0)
                inside = b.column("inside").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in ("id", "held", "n_tokens", "n_known", "base")] + [pa.array(inside + outside)],
                    names=["id", "held", "n_tokens", "n_known", "base", "score"],
                )
    return run


def _train(coded: DataFrame, shape: Shape, bias: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Weights of classes, then of decisions, after one pass over the training documents, averaged after each half."""
    weights = np.zeros((2 * shape.rows, CLASSES), np.float32)
    for half in range(HALVES):
        part = coded.where(~F.col("held") & (F.pmod(F.xxhash64("id", "hashes"), F.lit(HALVES)) == half))
        steps = part.select("hashes", "classes").mapInArrow(
            _updates(shape, weights, bias, odds), "row int, used long, weights array<float>"
        )
        mean = steps.groupBy("row").agg(*[
            (F.sum(F.get("weights", F.lit(c)) * F.col("used")) / F.sum("used")).alias(f"w{c}") for c in range(CLASSES)
        ]).toArrow()  # 2 * MOST_ROWS rows at most
        weights = weights.copy()
        if mean.num_rows:
            rows = mean.column("row").to_numpy()
            weights[rows] = np.stack([mean.column(f"w{c}").to_numpy() for c in range(CLASSES)], axis=1)
    return weights


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    A document is held out of all learning if crc32 of its id as text is divisible by ten.
    """
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    source = docs.select(F.col(key).cast("long").alias("id"), held.alias("held"), utf8(text).alias("text"))
    numbered = materialize(source.mapInArrow(_numbered, NUMBERED), "numbered")
    each = W.partitionBy("hash", "word")  # hashes are quick to sort by, words part those of one hash
    words = materialize(numbered.where("word IS NOT NULL").withColumn("hash", F.xxhash64("word")).select(
        "unit", "number", F.sum("n").over(each).alias("c"), (F.min("unit").over(each) == F.col("unit")).alias("first"),
        F.col("hash").bitwiseAND(0xFFFF).cast("int").alias("h"),
        *[F.sum(f"s{k}").over(each).alias(f"s{k}") for k in range(SIGNS)],
    ), "words")
    seen = words.where("first AND c > 0")
    totals = seen.agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(SIGNS)]
    ).first().asDict()
    totals = {k: v or 0 for k, v in totals.items()}
    whole = max(totals["n"], 1)
    kind = sum((
        F.when((F.col("c") > 0) & (F.col(f"s{k}") > F.col("c") * F.lit(totals[f"s{k}"] / whole)), 1 << k).otherwise(0)
        for k in range(SIGNS)
    ), F.lit(0)).cast("int")
    named = words.withColumn("class", kind)
    shape = Shape(totals["v"] + 1)
    leaf = F.shiftright("h", 16 - shape.bits).alias("leaf")
    sizes = named.where("first AND c > 0").groupBy("class", leaf).agg(
        F.sum("c").alias("c"), F.count("*").alias("v")
    ).toArrow()  # CLASSES * 2**10 rows at most
    leaf_tokens, leaf_words = np.zeros((2, CLASSES, 1 << shape.bits))
    if sizes.num_rows:
        at = sizes.column("class").to_numpy(), sizes.column("leaf").to_numpy()
        leaf_tokens[at], leaf_words[at] = sizes.column("c").to_numpy(), sizes.column("v").to_numpy()
    mass = leaf_tokens + SMOOTH * leaf_words
    mass[0, 0] += SMOOTH  # words without a training token
    class_tokens, odds = leaf_tokens.sum(axis=1), decision_odds(mass)
    units = numbered.where("words IS NOT NULL").select("unit", "id", "held", "words")
    coded = materialize(units.groupBy("unit").cogroup(
        named.select("unit", "number", "c", "class", "h").groupBy("unit")
    ).applyInArrow(_coded(shape, totals, mass), CODED), "coded")
    bias = np.log((class_tokens + 1) / (class_tokens.sum() + CLASSES)).astype(np.float32)
    weights = _train(coded, shape, bias, odds)
    scored = coded.mapInArrow(
        _scored(shape, weights, bias, odds), "id long, held boolean, n_tokens long, n_known long, base double, score double"
    )
    return scored.select(
        F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(totals["n"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
