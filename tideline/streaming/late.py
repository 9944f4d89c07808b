"""File-stream ingestion under a watermark, with late rows set aside.

The watermark of a batch is the newest date of all earlier batches less a delay. Rows
that are not older land as usual; rows behind it go to a side folder, from which
the windows to load again follow. A row that has already landed with the same or
a newer version is dropped; for that only the months since the watermark are read, so the
state is bounded by the delay, whatever the history. Rows behind the watermark are
not compared with the history at all: readers fold them by version.

Below ``target``: ``rows`` by month and batch, ``late`` by batch, ``marks`` by batch. What a batch
writes depends on earlier batches and itself alone and replaces only its own folders, so a
replay after a failure writes equal files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.resolve import keep_last
from tideline.session import materialize

MARK = T.StructType([T.StructField("mark", T.DateType()), T.StructField("batch_id", T.LongType())])


def _table(spark: SparkSession, path: str, schema: T.StructType, *keys: tuple[str, T.DataType]) -> DataFrame:
    """A table by folders, empty until the first write."""
    full = T.StructType([*schema.fields, *(T.StructField(name, kind) for name, kind in keys)])
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def landed_rows(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return _table(spark, f"{target}/rows", schema, ("month", T.IntegerType()), ("batch_id", T.LongType()))


def late_rows(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return _table(spark, f"{target}/late", schema, ("batch_id", T.LongType()))


def watermark(spark: SparkSession, target: str, before: int, delay_days: int):
    """Dates before this one are late for a batch; None for the first one."""
    marks = _table(spark, f"{target}/marks", T.StructType(MARK.fields[:1]), ("batch_id", T.LongType()))
    return marks.where(F.col("batch_id") < before).agg(F.date_sub(F.max("mark"), delay_days)).first()[0]


def seen_since(landed: DataFrame, cutoff, keys: Sequence[str], version: Sequence[str], date: str = "date") -> DataFrame:
    """Newest landed version per key on or after the watermark; only its months are read."""
    recent = landed.where((F.col("month") >= cutoff.year * 100 + cutoff.month) & (F.col(date) >= F.lit(cutoff)))
    return recent.groupBy(*keys).agg(F.max(F.struct(*version)).alias("_seen"))


def land_under_watermark(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], version: Sequence[str], delay_days: int, date: str = "date"
) -> StreamingQuery:
    """Process what has arrived, then stop. ``keys`` include the date; rows without a date are late."""
    schema = stream.schema

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = materialize(keep_last(batch, keys, version), "batch")
        cutoff = watermark(spark, target, batch_id, delay_days)
        behind = F.col(date).isNull() if cutoff is None else F.coalesce(F.col(date) < F.lit(cutoff), F.lit(True))
        on_time = newest.where(~behind)
        if cutoff is not None:
            earlier = landed_rows(spark, target, schema).where(F.col("batch_id") < batch_id)
            known = seen_since(earlier, cutoff, keys, version, date)
            fresh = F.col("_seen").isNull() | (F.struct(*version) > F.col("_seen"))
            on_time = on_time.join(known, list(keys), "left").where(fresh).drop("_seen")
        keyed = on_time.select(*schema.names, (F.year(date) * 100 + F.month(date)).alias("month"), F.lit(batch_id).alias("batch_id"))
        keyed.write.partitionBy("month", "batch_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{target}/rows")
        newest.where(behind).write.mode("overwrite").parquet(f"{target}/late/batch_id={batch_id}")
        newest.where(~behind).agg(F.max(date).alias("mark")).write.mode("overwrite").parquet(f"{target}/marks/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def late_windows(late: DataFrame, keys: Sequence[str] = ("series",), date: str = "date") -> DataFrame:
    """What has to be derived again: first and last late date of each key. Rows without a date have no window."""
    return late.where(F.col(date).isNotNull()).groupBy(*keys).agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count("*").alias("late_rows")
    )


def settled_rows(spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest row per key of all that landed in time or late; a later batch wins between equal versions."""
    rows = landed_rows(spark, target, schema).drop("month").unionByName(late_rows(spark, target, schema))
    return keep_last(rows, keys, [*version, "batch_id"]).drop("batch_id")
