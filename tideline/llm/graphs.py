"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it can reach, for every node of an edge (a, b).

    Alternates the large-star and the small-star step: every node points its
    larger (then its smaller) neighbours to the smallest one it knows. Rounds
    grow with the logarithm of the longest path. Each round is written to the
    shared folder; minima are combined before a shuffle, and are written too, so
    that adaptive execution can split the join of a hot node with its edges.
    """
    current = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct(), "edges")
    before = None
    while True:
        both = current.union(current.select("b", "a"))
        lowest = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "lowest")
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        large = materialize(large, "stars")
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(lowest, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            small.select("a", F.col("m").alias("b"))
        ).distinct()
        current = materialize(small, "edges")
        after = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if after == before:
            roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(roots.select("root", "root").distinct())
        before = after
