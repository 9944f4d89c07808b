"""Quality classifier: ordinal regression on graded ratings.

Ratings are grades 0 to K-1. The cumulative-link model has one weight per hashed
word and K-1 ordered thresholds: P(grade >= k) = sigmoid(w.x - t[k]). From it come
the expected grade and the probability of each tail, by which documents are
selected. A document's features are its distinct words and their first letters,
hashed to 2**18 buckets, and four of form. They are not scaled by length, so that a few words can decide a long text.

The model is fitted on at most ``sample`` rated documents, those of the smallest
hash of their ids, with numpy on the driver: this bound is the only thing that
does not grow with the input. All documents are scored, where they are read.

Defined results: null and empty texts have no features and get the expected grade
at w.x = 0. Ratings that are null or beyond the grades are left out. Without
ratings all weights are zero and the thresholds evenly spread. Repeated rows are
scored alike. Columns named like an output column are replaced, others kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import batch, tokens, utf8

BUCKETS, SAMPLE = 1 << 18, 10_000
MARKS = b".,;:!?()[]\"'"
SIGNIFICANT, ROUNDS, STEPS, RATE, SHRINK = 6.0, 3, 100, 0.1, 1e-4


@dataclass
class Grades:
    """Fitted model."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, value: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1."""
        return 1 / (1 + np.exp(-np.clip(value[:, None] - self.thresholds, -40, 40)))


def _style(text: bytes, words: list[bytes], counts: Counter) -> list[bytes]:
    """Features of form, as words that no text has: shares of its signs and words, in steps."""
    n = len(words)
    shares = {
        b"marks": sum(text.count(c) for c in b"#*$%&|<>!") / n, b"same": 1 - len(counts) / n,
        b"top": max(counts.values()) / n,
        b"upper": len(text.translate(None, bytes(set(range(256)) - set(range(65, 91))))) / len(text),
    }
    return [b" %s %d" % (name, min(9, int(10 * share))) for name, share in shares.items()]


def features(text: bytes | None) -> np.ndarray:
    """Buckets of the distinct words, their heads and the features of form of a text."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.int32)
    counts = Counter(w.strip(MARKS) for w in words)
    heads = {b"^" + w[:k] for w in counts for k in (4, 5)}
    found = [*counts, *heads, *_style(text, words, counts)]
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in found), np.int32, len(found))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t) for t in b.column("text").to_pylist()]
        yield batch(
            h=b.column("h"), id=b.column("id"), grade=b.column("grade"), at=pa.array([w.tobytes() for w in rows], pa.binary()),
        )


def fit(rated: DataFrame, grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE) -> Grades:
    """Fit on (key, text, grade) rows; see the module text for the bound."""
    good = rated.where(F.col(grade).between(0, grades - 1))
    chosen = good.select(
        F.col(grade).cast("int").alias("grade"), utf8(text).alias("text"), F.xxhash64(key).alias("h"), F.col(key).cast("string").alias("id")
    )
    rows = chosen.count()

    def smallest(of: DataFrame) -> dict:
        sparse = of.mapInArrow(_sparse, "h long, id string, grade int, at binary")
        return sparse.orderBy("h", "id", "grade", "at").limit(sample).toArrow().to_pydict()

    got = None
    if rows > sample:  # a threshold on the hash, a little generous, spares the features of most
        cut = int(-(2**63) + 2**64 * min(1.0, 1.2 * sample / rows))
        got = smallest(chosen.where(F.col("h") < F.lit(min(cut, 2**63 - 1))))
    if got is None or len(got["h"]) < sample:
        got = smallest(chosen)
    return fit_rows([np.frombuffer(a, np.int32) for a in got["at"]], np.array(got["grade"], np.int64), grades)


def fit_rows(x: list[np.ndarray], y: np.ndarray, grades: int) -> Grades:
    """Fit on feature buckets and grades.

    Most words say nothing of the grade, and together would fit the sample by
    heart. So a feature takes part only once its score test is significant: the
    residuals of the documents that have it add up to SIGNIFICANT standard
    deviations. Testing and fitting alternate, as what is fitted uncovers more.
    """
    share = np.array([min(max((y >= k).mean(), 0.01), 0.99) if len(y) else 1 - k / grades for k in range(1, grades)])
    model = Grades(np.zeros(BUCKETS), -np.log(share / (1 - share)))
    if not len(y):
        return model
    every = np.concatenate(x)
    of = np.repeat(np.arange(len(x)), [len(a) for a in x])
    frequent = np.maximum(np.bincount(every, minlength=BUCKETS), 1)
    rising = (y[:, None] >= np.arange(1, grades)).astype(float)
    chosen = np.zeros(BUCKETS, bool)
    for _ in range(ROUNDS):
        residual = (model.tails(np.bincount(of, model.weights[every], minlength=len(y))) - rising).sum(axis=1)
        test = np.bincount(every, residual[of], minlength=BUCKETS) / np.sqrt(frequent * max(residual.var(), 1e-9))
        chosen |= np.abs(test) >= SIGNIFICANT
        kept = chosen[every]
        row, n = of[kept], int(chosen.sum())
        at = (np.cumsum(chosen) - 1)[every[kept]]
        w = np.append(model.weights[chosen], model.thresholds)
        mean, square = np.zeros(len(w)), np.zeros(len(w))
        for step in range(1, STEPS + 1):  # Adam on all rows
            slope = Grades(w, w[n:]).tails(np.bincount(row, w[at], minlength=len(y))) - rising
            gradient = np.append(
                np.bincount(at, slope.sum(axis=1)[row], minlength=n) / len(y) + SHRINK * w[:n], -slope.mean(axis=0)
            )
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient ** 2
            w -= RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
            w[n:] = np.sort(w[n:])
        model.weights[chosen], model.thresholds = w[:n], w[n:]
    return model


def score(docs: DataFrame, model: Grades, text: str = "text") -> DataFrame:
    """All rows and columns with expected_grade and tail, P(top grade) (double)."""
    kept = [c for c in docs.columns if c not in ("expected_grade", "tail")]
    schema = T.StructType(
        [docs.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in ("expected_grade", "tail")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.encode() if t else None) for t in b.column(text).to_pylist()]
            value = np.array([float(model.weights[w].sum()) for w in found])
            tails = model.tails(value) if len(value) else np.zeros((0, len(model.thresholds)))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept] + [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])],
                names=[*kept, "expected_grade", "tail"],
            )
    return docs.mapInArrow(run, schema)


def classify(
    docs: DataFrame, rated: DataFrame, grades: int = 3, least: float = 0.5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Docs with expected_grade, tail and kept: the top grade is likelier than ``least``."""
    scored = score(docs, fit(rated, grades, key, text), text)
    return scored.withColumn("kept", F.col("tail") >= least)
