"""Published table to warehouse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tideline.operators.cleanse import cleanse_csv
from tideline.sinks.warehouse import append_new, load_full, reconcile
from tideline.sources.lake import scan_published, scan_published_csv


def published_rows(
    spark: SparkSession, root: str, key: str, null_columns: Sequence[str] = ()
) -> DataFrame:
    """The published table with warehouse columns, from its Parquet or CSV copy."""
    if key.strip().rstrip(".").lower().endswith(".csv"):
        return reconcile(cleanse_csv(scan_published_csv(spark, root, key), null_columns=null_columns))
    return reconcile(scan_published(spark, root, key))


def load_warehouse(
    spark: SparkSession, root: str, key: str, conn: dict[str, str], table: str, full: bool = False
) -> bool:
    """Replace the warehouse table, or append what is newer; False when nothing was."""
    rows = published_rows(spark, root, key)
    if full:
        load_full(rows, conn, table)
        return True
    return append_new(rows, conn, table)
