"""File-stream ingestion of daily rows with idempotent, versioned batches.

The stream lists files as they arrive and its checkpoint remembers what has been
taken, which replaces both waiting for a day's data and a hand-kept position.
A batch only ever writes its own ``batch_id`` folder: replaying it after a
failure rewrites the same folder, and nothing written earlier is touched.
Readers fold versions with :func:`current_rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.resolve import keep_last


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
    )


def land_batches(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    version: Sequence[str],
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Process what has arrived, then stop.

    Each batch is cleaned, folded to its newest row per key, and written under
    its batch number.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = batch if transform is None else batch.transform(transform)
        newest = keep_last(rows, keys, version)
        newest.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_rows(
    spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str], version: Sequence[str]
) -> DataFrame:
    """Newest row per key over all batches; a later batch wins between equal versions."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        rows = spark.read.schema(with_batch).parquet(target)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], with_batch)  # no batch has been written yet
    return keep_last(rows, keys, [*version, "batch_id"]).drop("batch_id")


def compact(
    spark: SparkSession, target: str, into: str, schema: T.StructType, keys: Sequence[str], version: Sequence[str]
) -> DataFrame:
    """Write the current rows to a fresh folder, one folder per date, for readers of single days."""
    rows = current_rows(spark, target, schema, keys, version)
    rows.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(into)
    return spark.read.schema(rows.schema).parquet(into)


def ingest_available(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    version: Sequence[str],
    files_per_batch: int = 1000,
) -> DataFrame:
    """Run one available-now pass and return the current rows."""
    stream = file_stream(spark, source, schema, files_per_batch)
    query = land_batches(stream, target, checkpoint, keys, version)
    query.awaitTermination()
    return current_rows(spark, target, schema, keys, version)


def day_files(rows: DataFrame, path: str, date: str = "date") -> None:
    """Lay rows out as one folder per day, the shape sources deliver."""
    keyed = rows.withColumn("day", F.col(date))
    keyed.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)
