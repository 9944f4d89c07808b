"""Hard negatives of anchors, with angular triangle filtering.

Vectors are scaled to integers and scored by their exact inner product. For each
anchor the best rows of its label are its positives, and for each positive the best
rows of other labels whose score lies in a window below the positive's score
are its negatives.

Filtering: every row stores its norm and its angles to some reference directions.
Angles obey the triangle inequality, so a row at angle y and an anchor at angle x
to one direction are at least |x - y| and at most min(x + y, 2 pi - x - y)
apart. The cosines of these, times both norms, bound the score from both sides;
bounds are widened by more than all rounding errors. Rows are sorted by label, nearest
direction and angle to it, and cut into blocks that also store the ends of all
their angles and norms. An anchor first scores its own block, which gives it a
least score for its positives. Blocks whose bounds miss what the anchors of a chunk
still need are dropped; in the others each anchor has a window of places along the block's direction, and only
the rows inside it are scored. Anchors grow with the table, so blocks meet chunks of them
by a join on the chunk's number, never by a broadcast; this is a search of a stated set of anchors against all rows.

The directions are picked from ``SAMPLE`` rows, the first by a hash of the id, each the furthest
from those before. They decide how much is scored, never what is found: all rows are indexed and
results are exact.

Defined results: rows without an id or label, without a vector, or with a null or
non-finite component (also after scaling) take no part. Rows that repeat an id, label and
vector count once; rows that share an id only are rows of their own, and none is a
positive of another one. Only vectors of equal length are compared; empty and zero
vectors score 0. Scores beyond 64 bits are returned as the largest (smallest) long. An anchor without positives or
negatives has no rows. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import blocks_for, rows_of
from tideline.session import materialize

REFERENCES, SAMPLE = 16, 1024
#: Rows of a block, anchors of a chunk, anchors scored at once.
BLOCK, CHUNK, AT_ONCE = 8192, 1024, 64
#: Wider than the error of any angle (that of a cosine of nearly 1 is below 1e-7).
MARGIN = 1e-6
#: Products of norms below this are summed exactly in double precision.
EXACT = 2.0**53
LONG = 2**63 - 1  # scores lie in [-LONG, LONG]; -LONG - 1 stands for no bound

KEYED = "id bigint, label string, anchor boolean, dim int, home int, angle double, norm double, raw binary, angles binary"
BLOCKS = (
    "block bigint, part int, dim int, n int, reference int, ids binary, labels array<string>, label_of binary, anchors binary, n_anchors int, "
    "raw binary, norms binary, angles binary, label_low string, label_high string, "
    "low array<double>, high array<double>, norm_low double, norm_high double"
)
ANCHORS = (
    "uid bigint, block bigint, part int, dim int, id bigint, label string, raw binary, norm double, angles binary, "
    "least bigint, most bigint, lows array<bigint>, highs array<bigint>"
)
SEEDED = ANCHORS + ", positives array<bigint>, found array<bigint>"
CHUNKS = (
    "chunk bigint, dim int, n int, uids binary, blocks binary, ids binary, labels array<string>, label_of binary, raw binary, "
    "norms binary, angles binary, least binary, most binary, lows binary, highs binary, label_low string, label_high string, "
    "low array<double>, high array<double>, norm_low double, norm_high double, needed double"
)
FOUND = "uid bigint, slot int, id bigint, score bigint"


def directions(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """Unit vectors, by length: the first of the sample, then always the furthest from all before."""
    out: dict[int, np.ndarray] = {}
    for dim in {len(v) for v in sample if v}:
        x = np.array([v for v in sample if len(v) == dim])
        x = x[np.abs(x).max(axis=1) > 0]
        if not len(x):
            continue
        x = unit(x)[0]
        picked = [0]
        nearest = x @ x[0]
        while len(picked) < min(REFERENCES, len(x)):
            picked.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, x @ x[picked[-1]])
        out[dim] = x[picked]
    return out


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as unit vectors (zero stays zero), and their norms."""
    if not x.size:
        return x, np.zeros(len(x))
    top = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / np.where(top > 0, top, 1)
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return scaled / np.where(length > 0, length, 1), (length * top)[:, 0]


def _keyed(found: dict[int, np.ndarray], scale: float):
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in KEYED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_dim: dict[int, list] = {}
            for key, label, anchor, vector in rows_of([b], "id", "label", "anchor", "vector"):
                if key is not None and label is not None and vector is not None and None not in vector:
                    by_dim.setdefault(len(vector), []).append((key, label, bool(anchor), vector))
            for dim, rows in by_dim.items():
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * np.array([r[3] for r in rows], np.float64).reshape(len(rows), dim)) + 0.0
                fit = np.flatnonzero(np.isfinite(x).all(axis=1))
                x = x[fit]
                if not len(x):
                    continue
                u, norms = unit(x)
                along = found.get(dim, np.zeros((0, dim)))
                angles = np.arccos(np.clip(u @ along.T, -1, 1))
                home = angles.argmin(axis=1) if len(along) else np.zeros(len(x), np.int64)
                near = angles[np.arange(len(x)), home] if len(along) else np.zeros(len(x))
                columns = [
                    *zip(*[rows[i][:3] for i in fit.tolist()]), [dim] * len(x), home.astype(np.int32), near, norms,
                    [r.tobytes() for r in x], [r.tobytes() for r in angles],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    return run


def _block(number: int, part: int, rows: list[tuple]) -> dict:
    ids, labels, anchors, dim, home, _, norms, raw, angles = zip(*rows)
    angles = np.frombuffer(b"".join(angles), np.float64).reshape(len(rows), -1)
    reference = int(np.bincount(home).argmax())
    order = np.argsort(angles[:, reference], kind="stable") if angles.size else np.arange(len(rows))
    angles, norms = angles[order], np.array(norms)[order]
    names = sorted(set(labels))
    code = {name: k for k, name in enumerate(names)}
    return {
        "block": number, "part": part, "dim": dim[0], "n": len(rows), "reference": reference,
        "ids": np.array(ids, np.int64)[order].tobytes(), "labels": names,
        "label_of": np.array([code[x] for x in labels], np.int32)[order].tobytes(),
        "anchors": np.array(anchors, np.bool_)[order].tobytes(), "n_anchors": sum(anchors), "raw": b"".join(raw[i] for i in order.tolist()),
        "norms": norms.tobytes(), "angles": angles.tobytes(), "label_low": names[0], "label_high": names[-1],
        "low": angles.min(axis=0).tolist(), "high": angles.max(axis=0).tolist(),
        "norm_low": float(norms.min()), "norm_high": float(norms.max()),
    }


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition to blocks; equal rows follow each other."""
    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    before, made = None, 0
    schema = _schema(BLOCKS)
    names = [c.split()[0] for c in KEYED.split(", ")]

    def flush():
        nonlocal rows, made
        if rows:
            yield pa.RecordBatch.from_pylist([_block((part << 16) + made, part, rows)], schema)
        rows, made = [], made + 1

    for b in batches:
        for row in rows_of([b], *names):
            key = (row[0], row[1], row[7])
            if key == before:
                continue
            before = key
            if rows and (len(rows) == 2 * BLOCK or row[3] != rows[0][3]):
                yield from flush()
            rows.append(row)
    yield from flush()


def _schema(ddl: str) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
        "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


class Side:
    """The arrays of a block or chunk."""

    def __init__(self, row: dict):
        n = row["n"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.names, self.label_of = np.array(row["labels"], object), np.frombuffer(row["label_of"], np.int32)
        self.raw = np.frombuffer(row["raw"], np.float64).reshape(n, row["dim"])
        self.norms = np.frombuffer(row["norms"], np.float64)
        self.angles = np.frombuffer(row["angles"], np.float64).reshape(n, -1)
        self.row = row

    def codes(self, names: np.ndarray) -> np.ndarray:
        """Labels as places among ``names``, -1 for others."""
        code = {name: k for k, name in enumerate(names)}
        return np.array([code.get(name, -1) for name in self.names], np.int32)[self.label_of]


def scores(a: np.ndarray, x: np.ndarray, norms: float) -> np.ndarray:
    """Exact inner products; ``norms`` is the largest product of two norms."""
    if norms < EXACT:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([int(v) for v in m.ravel().tolist()], object).reshape(m.shape)
    if not a.shape[1]:
        return np.zeros((len(a), len(x)), np.int64)
    return np.clip(whole(a) @ whole(x).T, -LONG, LONG).astype(np.int64)


def windows(
    angle: np.ndarray, norm: np.ndarray, least: np.ndarray, most: np.ndarray, along: np.ndarray, low: float, high: float
) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the places in ``along`` (sorted angles) that may score between ``least`` and ``most``.

    ``low`` and ``high`` are the smallest and largest norm of the rows.
    """
    least = np.where(least < -LONG, -math.inf, least)
    most = np.where(most >= LONG, math.inf, most)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        cos_least = np.where(least > 0, least / (norm * high), least / (norm * low))
        cos_most = np.where(most >= 0, most / (norm * low), most / (norm * high))
    cos_least = np.where(np.isnan(cos_least), -1, cos_least)
    cos_most = np.where(np.isnan(cos_most), 1, cos_most)
    furthest = np.arccos(np.clip(cos_least, -1, 1)) + MARGIN
    nearest = np.arccos(np.clip(cos_most, -1, 1)) - MARGIN
    begin = np.searchsorted(along, np.maximum(angle - furthest, nearest - angle))
    end = np.searchsorted(along, np.minimum(angle + furthest, 2 * math.pi - nearest - angle), side="right")
    none = cos_least > 1 + 1e-9
    return np.where(none, 0, begin), np.where(none, 0, np.maximum(begin, end))


def candidates(
    chunk: Side, block: Side, pick: np.ndarray, least: np.ndarray, most: np.ndarray, same_label: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the scores between ``least`` and ``most`` of the anchors ``pick``, same label or other."""
    size, reference = len(block.ids), block.row["reference"]
    if block.angles.shape[1]:
        begin, end = windows(
            chunk.angles[pick, reference], chunk.norms[pick], least[pick], most[pick], block.angles[:, reference],
            block.row["norm_low"], block.row["norm_high"],
        )
    else:
        begin, end = np.zeros(len(pick), np.int64), np.full(len(pick), size)
    order = np.argsort(begin, kind="stable")
    order = order[end[order] > begin[order]]
    mine, theirs = chunk.codes(block.names), block.label_of
    out = [(np.empty(0, np.int64),) * 3]
    for at in range(0, len(order), AT_ONCE):
        some = order[at:at + AT_ONCE]
        anchors, first, last = pick[some], int(begin[some].min()), int(end[some].max())
        got = scores(
            chunk.raw[anchors], block.raw[first:last], float(chunk.norms[anchors].max()) * block.row["norm_high"]
        )
        fit = (got >= least[anchors, None]) & (got <= most[anchors, None])
        equal = mine[anchors, None] == theirs[None, first:last]
        fit &= equal & (chunk.ids[anchors, None] != block.ids[None, first:last]) if same_label else ~equal
        i, j = np.nonzero(fit)
        out.append((anchors[i], j + first, got[i, j]))
    return tuple(np.concatenate(c) for c in zip(*out))


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` best of each group: highest score, then smallest id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.searchsorted(g, g)
    return order[np.arange(len(g)) - start < count]


def _last(group: np.ndarray, score: np.ndarray, groups: int, count: int) -> np.ndarray:
    """The last score of each group that has ``count`` of them, no bound for the others."""
    out = np.full(groups, LONG)
    np.minimum.at(out, group, score)
    return np.where(np.bincount(group, minlength=groups) == count, out, -LONG - 1)


def _found(uids, slots, ids, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(uids, pa.int64()), pa.array(slots, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64()),
    ], ["uid", "slot", "id", "score"])


def _sides(b: pa.RecordBatch, prefix: str, ddl: str) -> Iterator[Side]:
    names = [c.split()[0] for c in ddl.split(", ")]
    for row in rows_of([b], *[prefix + n for n in names]):
        yield Side(dict(zip(names, row)))


def _seeded(positives: int):
    """Blocks to their anchors, each with the scores of its best rows of the block."""
    def run(batches):
        schema = _schema(SEEDED)
        for b in batches:
            for block in _sides(b, "", BLOCKS):
                pick = np.flatnonzero(np.frombuffer(block.row["anchors"], np.bool_))
                if not len(pick):
                    continue
                n = len(block.ids)
                i, j, got = candidates(block, block, pick, np.full(n, -LONG - 1), np.full(n, LONG), True)
                best = first_of_each(i, got, block.ids[j], positives)
                i, j, got = i[best], j[best], got[best]
                least = _last(i, got, n, positives)
                edge = np.searchsorted(i, np.arange(n + 1))
                rows = [{
                    "uid": (block.row["block"] << 15) + k, "block": block.row["block"], "part": block.row["part"],
                    "dim": block.row["dim"], "id": int(block.ids[k]), "label": str(block.names[block.label_of[k]]),
                    "raw": block.raw[k].tobytes(), "norm": float(block.norms[k]), "angles": block.angles[k].tobytes(),
                    "least": int(least[k]), "most": LONG, "lows": [], "highs": [],
                    "positives": block.ids[j[edge[k]:edge[k + 1]]].tolist(),
                    "found": got[edge[k]:edge[k + 1]].tolist(),
                } for k in pick.tolist()]
                yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def _chunk(key: tuple, table: pa.Table) -> pa.Table:
    """Anchors of one chunk to one row."""
    t = table.sort_by("uid").to_pydict()
    column = lambda name, kind=np.float64: np.array(t[name], kind)
    names = sorted(set(t["label"]))
    code = {name: k for k, name in enumerate(names)}
    angles = np.frombuffer(b"".join(t["angles"]), np.float64).reshape(len(t["uid"]), -1)
    norms, least, most = column("norm"), column("least", np.int64), column("most", np.int64)
    return pa.Table.from_pylist([{
        "chunk": int(t["chunk"][0]), "dim": t["dim"][0], "n": len(norms), "uids": column("uid", np.int64).tobytes(),
        "blocks": column("block", np.int64).tobytes(), "ids": column("id", np.int64).tobytes(), "labels": names,
        "label_of": np.array([code[x] for x in t["label"]], np.int32).tobytes(), "raw": b"".join(t["raw"]),
        "norms": norms.tobytes(), "angles": angles.tobytes(), "least": least.tobytes(), "most": most.tobytes(),
        "lows": column("lows", np.int64).tobytes(), "highs": column("highs", np.int64).tobytes(), "label_low": names[0], "label_high": names[-1],
        "low": angles.min(axis=0).tolist(), "high": angles.max(axis=0).tolist(),
        "norm_low": float(norms.min()), "norm_high": float(norms.max()), "needed": float(least.min()) if least.min() >= -LONG else -math.inf,
    }], _schema(CHUNKS))


def _numbers(side: Side, name: str) -> np.ndarray:
    return np.frombuffer(side.row[name], np.int64)


def _more_positives(positives: int):
    """Pairs of a chunk and a block to the chunk's best rows of equal label, its anchors' own blocks left out."""
    def run(batches):
        for b in batches:
            for chunk, block in zip(_sides(b, "c_", CHUNKS), _sides(b, "", BLOCKS)):
                pick = np.flatnonzero(_numbers(chunk, "blocks") != block.row["block"])
                pick = pick[chunk.codes(block.names)[pick] >= 0]
                i, j, got = candidates(chunk, block, pick, _numbers(chunk, "least"), _numbers(chunk, "most"), True)
                best = first_of_each(i, got, block.ids[j], positives)
                if len(best):
                    uids = _numbers(chunk, "uids")[i[best]]
                    yield _found(uids, np.zeros(len(best), np.int32), block.ids[j[best]], got[best])
    return run


def _negatives(negatives: int):
    """Pairs of a chunk and a block to the best rows of other labels in each anchor's windows.

    What a task has found for a chunk raises the scores that its later blocks must reach.
    """
    def run(batches):
        reached: dict[tuple, np.ndarray] = {}
        for b in batches:
            for chunk, block in zip(_sides(b, "c_", CHUNKS), _sides(b, "", BLOCKS)):
                n = len(chunk.ids)
                lows, highs = (_numbers(chunk, k).reshape(n, -1) for k in ("lows", "highs"))
                slots = lows.shape[1]
                key = (chunk.row["chunk"], chunk.row["dim"])
                floor = np.maximum(lows, reached.get(key, -LONG - 1))
                empty = floor > highs
                least, most = np.where(empty, LONG, floor).min(axis=1), np.where(empty, -LONG - 1, highs).max(axis=1)
                i, j, got = candidates(chunk, block, np.flatnonzero(least <= most), least, most, False)
                if not len(i):
                    continue
                inside = (got[:, None] >= floor[i]) & (got[:, None] <= highs[i])
                k, slot = np.nonzero(inside)
                group = i[k] * slots + slot
                best = first_of_each(group, got[k], block.ids[j[k]], negatives)
                k, slot, group = k[best], slot[best], group[best]
                if len(reached) >= 64 and key not in reached:
                    reached.clear()
                reached[key] = np.maximum(
                    _last(group, got[k], n * slots, negatives).reshape(n, slots), reached.get(key, -LONG - 1)
                )
                yield _found(_numbers(chunk, "uids")[i[k]], slot.astype(np.int32) + 1, block.ids[j[k]], got[k])
    return run


def _pairs(blocks: DataFrame, chunks: DataFrame, numbers: int, equal_labels: bool) -> DataFrame:
    """Each chunk beside each block that its anchors may need, the chunk's columns prefixed."""
    ends = ["dim", "label_low", "label_high", "low", "high", "norm_low", "norm_high"]
    c = chunks.select("chunk", *[F.col(x).alias(f"c_{x}") for x in [*ends, "needed"]])
    b = blocks.select("block", *ends, F.explode(F.expr(f"sequence(0L, {numbers - 1}L)")).alias("chunk"))
    less = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
    gaps = F.zip_with(less("low", "c_high"), less("c_low", "high"), lambda p, q: F.greatest(p, q))
    cosine = F.cos(F.greatest(F.coalesce(F.array_max(gaps), F.lit(0.0)) - MARGIN, F.lit(0.0)))
    norms = F.when(cosine >= 0, F.col("norm_high") * F.col("c_norm_high")).otherwise(F.col("norm_low") * F.col("c_norm_low"))
    bound = cosine * norms
    fit = (F.col("dim") == F.col("c_dim")) & (bound + F.abs(bound) * 1e-9 + 1 >= F.col("c_needed"))
    if equal_labels:
        fit &= (F.col("label_low") <= F.col("c_label_high")) & (F.col("label_high") >= F.col("c_label_low"))
    near = b.join(c, "chunk").where(fit).select("block", "chunk", "dim")
    full = chunks.select(F.col("chunk"), F.col("dim"), *[F.col(x).alias(f"c_{x}") for x in chunks.columns])
    return near.join(full, ["chunk", "dim"]).drop("chunk", "dim").join(blocks, "block")


def _best(found: DataFrame, count: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def mine(
    rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: float = 256.0, positives: int = 5, negatives: int = 5, percent: int = 80,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchors`` holds.

    A negative n of a positive p has ``percent * p <= 100 * n <= 100 * p``.
    """
    spark = rows.sparkSession
    given = rows.select(
        F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), anchors.alias("anchor"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    usable = given.where(F.expr(
        "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND "
        "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    ))
    sample = usable.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("vector").collect()
    keyed = materialize(usable.mapInArrow(_keyed(directions([r.vector for r in sample]), scale), KEYED), "vectors")
    counts = keyed.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    parts = blocks_for(counts.n, BLOCK)
    order = ["dim", "label", "home", "angle", "id"]
    blocks = materialize(
        keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "raw").mapInArrow(_blocks, BLOCKS), "blocks"
    )
    spread = max(1, CHUNK * parts // max(1, counts.anchors))
    chunk_of = F.floor(F.col("part") / spread).cast("bigint")
    seeded = materialize(blocks.where("n_anchors > 0").mapInArrow(_seeded(positives), SEEDED), "anchors")
    numbers = 1 + ((seeded.agg(F.max("part")).first()[0] or 0) // spread)
    plain = seeded.drop("positives", "found").withColumn("chunk", chunk_of)
    chunks = materialize(plain.groupBy("chunk", "dim").applyInArrow(_chunk, CHUNKS), "chunks")
    seeds = seeded.select("uid", F.explode(F.arrays_zip("positives", "found")).alias("x")).select(
        "uid", F.lit(0).alias("slot"), F.col("x.positives").alias("id"), F.col("x.found").alias("score")
    )
    more = _pairs(blocks, chunks, numbers, True).mapInArrow(_more_positives(positives), FOUND)
    chosen = materialize(_best(seeds.unionByName(more), positives, "uid").select(
        "uid", F.col("place").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    ), "positives")
    # ceil(percent * p / 100) without overflow; an absent slot is an empty window
    p = F.col("positive_score")
    low = F.expr(f"positive_score div 100 * {percent} + CAST(ceil(positive_score % 100 * {percent} / 100D) AS BIGINT)")
    slots = F.sequence(F.lit(1), F.lit(positives))
    window = chosen.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(
        low.alias("low"), p.alias("high")
    )))).alias("by_slot"))
    ends = window.select("uid", *[
        F.transform(slots, lambda k: F.coalesce(F.col("by_slot")[k][end], F.lit(absent))).alias(name)
        for name, end, absent in (("lows", "low", LONG), ("highs", "high", -LONG))
    ])
    wanted = plain.drop("least", "most", "lows", "highs").join(ends, "uid").withColumns({
        "least": F.array_min("lows"), "most": F.array_max("highs")
    })
    wanted = materialize(
        wanted.where("least <= most").select(*plain.columns).groupBy("chunk", "dim").applyInArrow(_chunk, CHUNKS), "windows"
    )
    found = _pairs(blocks, wanted, numbers, False).mapInArrow(_negatives(negatives), FOUND)
    named = seeded.select("uid", F.col("id").alias("anchor_id"))
    return (
        _best(found, negatives, "uid", "slot").join(chosen, ["uid", "slot"]).join(named, "uid")
        .select(
            "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )
