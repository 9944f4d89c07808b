"""Keyed upserts and high-water-mark appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_rows(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Rows of ``new`` plus the rows of ``old`` whose key is absent from ``new``.

    Whole-row replacement: a key in ``new`` drops the old row even where the new
    one has NULLs. Applying the same batch twice changes nothing.
    """
    touched = new.select(*keys).distinct()
    kept = old.join(touched, list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_cells(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """As :func:`upsert_rows`, but a NULL in ``new`` keeps the old cell.

    Both sides must be unique on ``keys``.
    """
    both = old.withColumn("_new", F.lit(False)).unionByName(
        new.withColumn("_new", F.lit(True)), allowMissingColumns=True
    )
    cells = [c for c in both.columns if c not in (*keys, "_new")]
    return both.groupBy(*keys).agg(*[
        F.coalesce(
            F.max(F.when(F.col("_new"), F.col(c))), F.max(F.when(~F.col("_new"), F.col(c)))
        ).alias(c)
        for c in cells
    ])


def newer_than(df: DataFrame, target: DataFrame, column: str = "date") -> DataFrame:
    """Rows strictly after the newest row of ``target``; all rows when it is empty.

    The mark is a scalar subquery that is never NULL, so the comparison reaches
    the Parquet scan of ``df`` as a plain filter.
    """
    mark = target.agg(
        F.coalesce(F.max(column), F.lit("0001-01-01").cast(df.schema[column].dataType)).alias("mark")
    ).scalar()
    return df.where(F.col(column) > mark)


def high_water_mark(target: DataFrame, column: str = "date") -> DataFrame:
    return target.agg(F.max(column).alias(f"max_{column}"))
