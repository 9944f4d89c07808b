"""Near-duplicate documents: chosen-path set similarity join.

A document is the set of its distinct word shingles. Independent trees branch
documents by minwise tokens: a root node holds documents with one minwise token
in common, a child those that share another token chosen by the path. Small nodes
are compared exhaustively. A pair of similarity s meets at a root with chance s,
and survives a branching (two tokens) with 1 - (1-s)**2, so at 0.85 eight trees
of up to three branchings miss it with a chance below 1e-5.

Nodes compare 128-token sketches and keep a forest of the pairs whose estimate is
0.68 or more (over five standard deviations below 0.85), never all pairs. The
trees' forests make candidate groups, inside which links are decided on the full
sets, again without testing what is linked already.

A group of any size is dealt out in tiles: a block of members beside the group's
first block. What joins the largest class of that first block is settled; the
rest, few in a group of near copies, is compared with every block of the group.

Defined results: empty and null texts have an empty set, link with nothing and
stay; so do rows without an id, whose component is null. Texts with fewer words
than a shingle are one shingle. Equal sets are one class, whatever the number of
copies. Rows repeating an id with one text get equal results. One row is returned
per input row, with the result's columns alone. An empty table gives an empty result. Shingles are compared by 64-bit and sets by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import batch, mix, rows_of, tokens, utf8
from tideline.llm.graphs import components
from tideline.session import materialize

TREES, SKETCH, SLACK = 8, 128, 0.17
BLOCK, BRANCHINGS, BRANCHES, DENSE = 128, 3, 2, 0.7
VOCABULARY = 400_000  # words whose hashes a worker remembers

_rng = np.random.default_rng(20240417)
ODD = _rng.integers(1, 2**63, SKETCH + TREES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALT = _rng.integers(1, 2**63, SKETCH + TREES, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(out)])
    return np.unique(out)


def sketch(shingles: np.ndarray) -> tuple[bytes, np.ndarray]:
    """16-bit sketch and the 64-bit root tokens."""
    lowest = np.full(SKETCH + TREES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        part = shingles[at:at + 1024, None]
        np.minimum(lowest, ((part ^ SALT) * ODD).min(axis=0), out=lowest)
    return (lowest[:SKETCH] >> np.uint64(48)).astype(np.uint16).tobytes(), lowest[SKETCH:]


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _signatures(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, digests, sketches, roots = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, size, hashes)
                n.append(len(s))
                digests.append(_digest(s))
                low, root = sketch(s) if len(s) else (None, np.zeros(0, np.uint64))
                sketches.append(low)
                roots.append(root.view(np.int64).tolist())
            yield batch(
                id=b.column("id").cast(pa.int64()), n=pa.array(n, pa.int64()), digest=pa.array(digests, pa.binary()),
                sketch=pa.array(sketches, pa.binary()), roots=pa.array(roots, pa.list_(pa.int64())),
            )
    return run


class Forest:
    """Classes of members 0..n-1 and the links that made them."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def compare_tile(n: np.ndarray, sketches: np.ndarray, roles: np.ndarray, threshold: float, exact=None):
    """Forest of a tile, and which members the largest class of the first block does not hold.

    roles: 0 of the first block, 1 other, 2 one of the rest in its second pass,
    where only pairs with a 2 are compared. exact(i, j) decides if given, else
    the estimate does.
    """
    order = np.lexsort((np.arange(len(n)), roles != 0))
    forest, least = Forest(len(n)), threshold - SLACK
    firsts = int((roles == 0).sum())
    for place, i in enumerate(order):
        others = order[:place]
        if roles[i] != 2:
            others = others[roles[others] == 2] if (roles == 2).any() else others
        if not len(others):
            continue
        near = np.minimum(n[others], n[i]) >= threshold * np.maximum(n[others], n[i])
        others = others[near]
        alike = (sketches[others] == sketches[i]).mean(axis=1)
        found = np.flatnonzero(alike >= least)
        for k in found[np.argsort(-alike[found], kind="stable")]:
            j = int(others[k])
            if forest.find(i) != forest.find(j) and (exact is None or exact(int(i), j)):
                forest.link(int(i), j)
    if not firsts:
        return forest, np.zeros(len(n), bool)
    start = Forest(len(n))
    for i, j in forest.links:
        if roles[i] == 0 and roles[j] == 0:
            start.link(i, j)
    heads = [start.find(int(i)) for i in order[:firsts]]
    main = max(set(heads), key=lambda h: (heads.count(h), -heads.index(h)))
    held = forest.find(main)
    return forest, np.array([forest.find(i) != held for i in range(len(n))])


EDGE = "tile binary, a binary, b binary"


def _tiles(threshold: float, size: int, exact: bool) -> Callable:
    """Group function: links (a, b), and (a, null) for a member to be compared with every block."""
    def run(group: pa.Table) -> pa.Table:
        digests = group.column("digest").to_pylist()
        keep = list({d: i for i, d in reversed(list(enumerate(digests)))}.values())
        if exact and len(keep) < len(digests):  # an id repeats; a row of another text has not this digest
            own = [_digest(shingle_set(t, size, WordHashes())) for t in group.column("text").to_pylist()]
            keep = list({d: i for i, d in enumerate(digests) if own[i] == d}.values())
        keep.sort(key=lambda i: digests[i])
        group = group.take(keep)
        digests = [digests[i] for i in keep]
        n = group.column("n").to_numpy()
        sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
        roles = group.column("role").to_numpy()
        decide = None
        if exact:
            hashes, texts, sets = WordHashes(), group.column("text").to_pylist(), {}

            def decide(i: int, j: int) -> bool:
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingle_set(texts[k], size, hashes)
                both = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
                return 100 * both >= round(100 * threshold) * (len(sets[i]) + len(sets[j]) - both)
        forest, rest = compare_tile(n, sketches, roles, threshold, decide)
        many = group.column("blocks")[0].as_py() > 1 and not (roles == 2).any()
        alone = [digests[i] for i in np.flatnonzero(rest)] if many else []
        key = group.column("key")[0].as_py()
        return pa.table({
            "tile": pa.array([key] * (len(forest.links) + len(alone)), pa.binary()),
            "a": pa.array([digests[i] for i, _ in forest.links] + alone, pa.binary()),
            "b": pa.array([digests[j] for _, j in forest.links] + [None] * len(alone), pa.binary()),
        })
    return run


def _dealt(members: DataFrame) -> DataFrame:
    """Members (key, digest, size, ...) with the tiles they take part in."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks").cast("long")).cast("int")
    placed = members.withColumn("blocks", F.when(F.col("size") <= 2 * BLOCK, 1).otherwise(blocks)).withColumn("block", block)
    tiles = F.when(
        (F.col("block") == 0) & (F.col("blocks") > 1), F.sequence(F.lit(1), F.col("blocks") - 1)
    ).otherwise(F.array("block"))
    return placed.withColumn("role", F.when(F.col("block") == 0, 0).otherwise(1)).withColumn("tile", F.explode(tiles))


def _linked(members: DataFrame, threshold: float, size: int, exact: bool, name: str) -> DataFrame:
    """Links inside the groups named by ``key``; see the module text for groups of many blocks."""
    work = _tiles(threshold, size, exact)
    first = materialize(_dealt(members).groupBy("key", "tile").applyInArrow(work, EDGE), name)
    alone = first.where("b IS NULL").select(F.col("tile").alias("key"), F.col("a").alias("digest")).distinct()
    links = first.where("b IS NOT NULL").select("a", "b")
    if alone.isEmpty():
        return links
    sizes = alone.groupBy("key").count().select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    marked = alone.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts").cast("long")).cast("int"))
    big = members.where(F.col("size") > 2 * BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rest = big.join(marked, ["key", "digest"]).select(
        *big.columns, "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(2).alias("role")
    )
    every = big.join(sizes, "key").select(
        *big.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("digest"), F.col("blocks").cast("long")).cast("int").alias("block"), F.lit(1).alias("role"),
    ).join(alone, ["key", "digest"], "left_anti").select(*rest.columns)
    second = rest.union(every).groupBy("key", "part", "block").applyInArrow(work, EDGE)
    return links.union(materialize(second, name).where("b IS NOT NULL").select("a", "b")).union(
        # the rest among themselves meet in every block; one is enough, but they may be in different parts
        _among(rest, work, name)
    )


def _among(rest: DataFrame, work: Callable, name: str) -> DataFrame:
    """Links between parts of the rest: each pair of parts is one tile."""
    each = rest.where("block = 0").drop("block", "role")
    parts = each.groupBy("key").agg((F.max("part") + 1).alias("parts"))
    paired = each.join(parts, "key").where("parts > 1").select(
        *each.columns, "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select(
        *each.columns, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), F.lit(2).alias("role")
    )
    return materialize(paired.groupBy("key", "low", "high").applyInArrow(work, EDGE), name).where(
        "b IS NOT NULL").select("a", "b")


def _sized(members: DataFrame) -> DataFrame:
    """Members of nodes of two or more, with the node's size."""
    # written, so that adaptive execution can split the join of a hot node
    sizes = materialize(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    return members.join(sizes, "key")


def candidate_links(classes: DataFrame, threshold: float, size: int) -> DataFrame:
    """Forests of pairs whose sketches are alike, over all trees."""
    def token(at) -> F.Column:
        return F.substring("sketch", 2 * at + 1, F.lit(2))

    level = materialize(_sized(classes.select(
        "digest", "n", "sketch", F.posexplode("roots").alias("tree", "root")
    ).select(F.md5(F.concat_ws(" ", "tree", "root")).cast("binary").alias("key"), "digest", "n", "sketch")), "nodes")
    leaves = []
    settled = F.col("size") <= BLOCK
    for _ in range(BRANCHINGS):
        leaves.append(level.where(settled))
        large = level.where(~settled)
        if large.isEmpty():
            level = large
            break
        children = large.select(
            "key", "digest", "n", "sketch", "size", F.explode(F.array(*[F.lit(j) for j in range(BRANCHES)])).alias("j")
        ).withColumn("at", F.pmod(F.xxhash64("key", "j"), F.lit(SKETCH)).cast("int")).select(
            F.md5(F.concat("key", F.hex("at").cast("binary"), token(F.col("at")))).cast("binary").alias("key"),
            "digest", "n", "sketch", F.col("size").alias("parent"),
        )
        level = materialize(_sized(children), "nodes")
        # a child that keeps most of its parent holds near copies, which no branching parts
        settled = (F.col("size") <= BLOCK) | (F.col("size") > DENSE * F.col("parent"))
    leaves.append(level)
    columns = ("key", "digest", "n", "sketch", "size")
    nodes = leaves[0].select(*columns)
    for more in leaves[1:]:
        nodes = nodes.union(more.select(*columns))
    return _linked(nodes, threshold, size, False, "candidates").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the class) and kept, one row per input row."""
    source = docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("text"))
    signed = materialize(source.mapInArrow(
        _signatures(shingle), "id long, n long, digest binary, sketch binary, roots array<long>"
    ), "signatures")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("digest", "n", "sketch", "roots").agg(F.min("id").alias("id"))
    classes = materialize(classes, "classes")
    groups = materialize(components(candidate_links(classes, threshold, shingle)), "groups")
    sizes = materialize(groups.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    members = groups.join(sizes, "root").select(F.col("root").alias("key"), F.col("node").alias("digest"), "size").join(
        classes.select("digest", "n", "sketch", "id"), "digest"
    )
    texts = source.where("id IS NOT NULL").join(members, "id")
    links = _linked(materialize(texts, "members"), threshold, shingle, True, "links")
    found = components(links)
    owned = classes.select("digest", "id").join(
        found.select(F.col("node").alias("digest"), "root"), "digest", "left"
    ).withColumn("root", F.coalesce("root", "digest"))
    smallest = owned.groupBy("root").agg(F.min("id").alias("component_id"))
    named = owned.join(smallest, "root").select("digest", "component_id")
    out = signed.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
