"""Marks from Parquet footers: extremes and counts of a stored table without reading its pages.

Spark pushes MIN, MAX and COUNT of whole columns (numbers and dates) down to the footers where the
newer Parquet reader and its aggregate push-down are switched on. Both are set for
the one aggregate only, and put back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def footer_aggregates(spark: SparkSession) -> Iterator[None]:
    """Inside, aggregates over Parquet may come from footers; plans must be made and run inside."""
    before = {key: spark.conf.get(key) for key in FOOTERS}
    for key, value in FOOTERS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def extremes(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str]) -> DataFrame:
    """``rows``, and ``min_c`` and ``max_c`` of each column. Call and run it inside :func:`footer_aggregates`."""
    bounds = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return spark.read.schema(schema).parquet(path).agg(F.count("*").alias("rows"), *bounds)


def stored_marks(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] = ("date",)) -> Row:
    """Rows and extremes of a stored table, from its footers."""
    with footer_aggregates(spark):
        return extremes(spark, path, schema, columns).first()


def newer_than_stored(df: DataFrame, path: str, schema: T.StructType, column: str = "date") -> DataFrame:
    """Rows of ``df`` after the newest stored one (all if there is none); a literal bound, which reaches the scan."""
    mark = stored_marks(df.sparkSession, path, schema, (column,))[f"max_{column}"]
    return df if mark is None else df.where(F.col(column) > F.lit(mark))
