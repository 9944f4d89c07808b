"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors are projected on many random directions. Along each direction they are
sorted, and a vector collides with those inside a window centred on it. Two unit
vectors at cosine c differ along a direction by a normal deviate whose scale is
their distance, so the number of collisions of a pair is binomial; the count a
pair must reach is the largest that keeps the wanted recall at the threshold.
Pairs that reach it are verified by their cosine in double precision.

Only vectors of one label and length are compared. Equal vectors are joined
before, so a hot group of copies is one vector. A label is dealt out in pairs of
equal blocks, so no task takes more than two of them; what a task returns grows
with its vectors, not with its links: how many links each has, and a forest of them.
The work of a label is quadratic in its distinct vectors.

Defined results: vectors that are null, empty, zero or not finite, and rows
without a label, link with nothing, have no links and stay. Rows without an id
count as links of others but have no component. Rows that repeat an id and vector
count each other. An empty table gives an empty result. Only the id and the
results are returned, one row per input row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import batch
from tideline.llm.graphs import components
from tideline.llm.set_join import Forest
from tideline.session import materialize

PROJECTIONS, WINDOW, RECALL, BLOCK = 32, 2.0, 0.9999, 1024
SEED = 99


def needed_collisions(projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """Largest count that a pair at the threshold reaches with the given probability.

    The window is given in units of the threshold's distance.
    """
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for count in range(projections, 0, -1):
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= recall:
            return count
    return 1


def candidates(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (i, j) of unit vectors x[i], y[j] that collide often enough.

    All are sorted along a line; a window is an interval of places in that order.
    """
    reach = WINDOW * math.sqrt(2 - 2 * threshold)
    lines = np.concatenate([x, y]) @ np.random.default_rng(SEED).standard_normal((x.shape[1], PROJECTIONS))
    counts = np.zeros((len(x), len(y)), np.uint8)
    for k in range(PROJECTIONS):
        order = np.argsort(lines[:, k], kind="stable")
        along, centre = lines[order, k], lines[:len(x), k]
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        first = np.searchsorted(along, centre - reach).astype(np.uint32)
        width = np.searchsorted(along, centre + reach, side="right").astype(np.uint32) - first
        counts += place[None, len(x):] - first[:, None] < width[:, None]  # places before the window wrap around
    return np.argwhere(counts >= needed_collisions())


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, vectors = [], []
        for vector, label in zip(b.column("vector").to_pylist(), b.column("label").to_pylist()):
            x = None if not vector or label is None or None in vector else np.array(vector, np.float64)
            if x is None or not np.isfinite(x).all() or not x.any():
                keys.append(None)
                vectors.append(None)
            else:
                raw = x.tobytes()
                keys.append(xxhash.xxh3_128_digest(str(label).encode() + b"\0" + raw))
                vectors.append(raw)
        yield batch(
            id=b.column("id"), label=b.column("label"), key=pa.array(keys, pa.binary()), raw=pa.array(vectors, pa.binary())
        )


LINKS = "a binary, b binary, n long"


def _tile(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        keys, copies = group.column("key").to_pylist(), group.column("copies").to_numpy()
        x = np.frombuffer(b"".join(group.column("raw").to_pylist()), np.float64).reshape(len(keys), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        sides = group.column("block").to_numpy()
        left = np.flatnonzero(sides == sides.min())
        right = np.flatnonzero(sides == sides.max())
        forest, linked = Forest(len(keys)), np.zeros(len(keys), np.int64)
        for i, j in candidates(x[left], x[right], threshold):
            i, j = int(left[i]), int(right[j])
            if (i < j or left[0] != right[0]) and float(x[i] @ x[j]) >= threshold:
                linked[i] += copies[j]
                linked[j] += copies[i]
                forest.link(i, j)
        has = np.flatnonzero(linked)
        return pa.table({
            "a": pa.array([keys[i] for i, _ in forest.links] + [keys[i] for i in has], pa.binary()),
            "b": pa.array([keys[j] for _, j in forest.links] + [None] * len(has), pa.binary()),
            "n": pa.array([0] * len(forest.links) + linked[has].tolist(), pa.int64()),
        })
    return run


def near_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93
) -> DataFrame:
    """The id with n_links, component_id (smallest id of the class) and kept."""
    keyed = materialize(rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).mapInArrow(_keyed, "id long, label string, key binary, raw binary"), "vectors")
    distinct = materialize(keyed.where("key IS NOT NULL").groupBy("label", "key", "raw").agg(
        F.count("*").alias("copies"), F.min("id").alias("id")
    ), "distinct")
    dim = F.length("raw")
    sizes = materialize(distinct.groupBy("label", dim.alias("dim")).agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    ), "sizes")
    placed = distinct.withColumn("dim", dim).join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, ["label", "dim"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({
        "low": F.least("block", "other"), "high": F.greatest("block", "other")
    })
    tiles = materialize(
        dealt.groupBy("label", "dim", "low", "high").applyInArrow(_tile(threshold), LINKS), "links"
    )
    found = components(tiles.where("b IS NOT NULL").select("a", "b"))
    counts = tiles.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    owned = distinct.select("key", "id", "copies").join(
        found.select(F.col("node").alias("key"), "root"), "key", "left"
    ).join(counts, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = owned.groupBy("root").agg(F.min("id").alias("component_id"))
    named = materialize(owned.join(smallest, "root").select(
        "key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ), "named")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return keyed.join(named, "key", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
