"""Picking one row per key: newest version, preferred source, page overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under ``order``, which must be total.

    ``row_number() = 1`` plans with a group limit below the exchange: every map
    task keeps one row per key before the shuffle, so a key holding a third of
    the input still reaches its reducer as one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest version of each key; later entries of ``version`` break ties."""
    return first_per_key(df, keys, [F.col(v).desc_nulls_last() for v in version])


def keep_preferred(
    df: DataFrame, keys: Sequence[str], rank: str, version: Sequence[str] = ()
) -> DataFrame:
    """Row of the lowest ``rank`` per key, newest version first among equals."""
    order = [F.col(rank).asc_nulls_last()] + [F.col(v).desc_nulls_last() for v in version]
    return first_per_key(df, keys, order)


def merge_pages(pages: Sequence[DataFrame], keys: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """Union of overlapping backfill pages with one row per key.

    The newest ``version`` wins; ties go to the largest values of the other
    columns, so that the order of pages does not matter.
    """
    merged = union_all(pages)
    rest = [c for c in merged.columns if c not in (*keys, *version)]
    return keep_last(merged, keys, [*version, *rest] or list(keys))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by name; columns missing on one side become NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
