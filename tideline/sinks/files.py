"""File planning for partitioned Parquet tables: sizes in bytes, clustering, compaction, touched partitions.

The number of rows in a file says little about its size. Here rows are staged once, the bytes they took are
measured, and from them follows the number of range partitions of the write. Ranges go over the folder keys and
the clustering columns together, so a large folder is split over many tasks, small folders share one,
a hot ticker is split by date, and every file holds a narrow range whose row-group statistics let
a filter skip the rest.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.upsert import upsert_rows
from tideline.session import materialize, scratch_path

TARGET_BYTES = 128 << 20


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``file, folder, length`` of the data files below ``path``, from the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length")


def bytes_of(spark: SparkSession, path: str) -> int:
    return file_sizes(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def folder_plan(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Each folder's files and bytes, and how many files of the target size it would need."""
    return file_sizes(spark, path).groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"),
        F.greatest(F.lit(1), F.ceil(F.sum("length") / target_bytes)).alias("planned"),
    )


def write_clustered(
    df: DataFrame, path: str, keys: Sequence[str], cluster: Sequence[str], target_bytes: int = TARGET_BYTES, mode: str = "dynamic"
) -> int:
    """Write ``df`` to folders by ``keys``, in files of about ``target_bytes`` that are sorted by ``cluster``.

    ``dynamic`` replaces the folders in ``df``, ``static`` the whole table. Returns the
    number of ranges. A range that crosses folders gives each of them a file of its own.
    ``df`` may read from ``path``, as it is staged before anything is replaced.
    """
    spark = df.sparkSession
    staged_at = scratch_path(spark, "staged")
    df.write.parquet(staged_at)
    staged = spark.read.schema(df.schema).parquet(staged_at)
    ranges = max(1, math.ceil(bytes_of(spark, staged_at) / target_bytes))
    order = [*keys, *cluster]
    spread = staged.repartitionByRange(ranges, *order) if ranges > 1 else staged.coalesce(1)
    writer = spread.sortWithinPartitions(*order).write.option("partitionOverwriteMode", mode).mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    return ranges


def compact_folders(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], cluster: Sequence[str], target_bytes: int = TARGET_BYTES
) -> int:
    """Rewrite the folders that have more files than their bytes need; the others are not read.

    ``schema`` includes the keys. Returns the number of folders rewritten; a second run finds none.
    """
    plan = folder_plan(spark, path, target_bytes)
    # one file more than planned is what a range that ends inside a folder leaves
    many = plan.where(F.col("files") > F.col("planned") + 1).select("folder").collect()
    if not many:
        return 0
    values = [tuple(part.split("=", 1) for part in r.folder.split("/")[-len(keys):]) for r in many] if keys else []
    rows = spark.read.schema(schema).parquet(path)
    if keys:
        unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        chosen = [[unescape(v) for _, v in found] for found in values]
        rows = rows.where(_any_of(rows, keys, chosen))
    write_clustered(rows, path, keys, cluster, target_bytes)
    return len(many)


#: Folder of rows whose key is NULL.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _any_of(rows: DataFrame, keys: Sequence[str], chosen: Sequence[Sequence[str]]):
    """A filter on partition values that Spark prunes folders by."""
    if len(keys) == 1:
        known = [v for (v,) in chosen if v != NULL_FOLDER]
        found = F.col(keys[0]).isin([F.lit(v).cast(rows.schema[keys[0]].dataType) for v in known]) if known else F.lit(False)
        return found | F.col(keys[0]).isNull() if len(known) < len(chosen) else found
    out = F.lit(False)
    for values in chosen:
        here = F.lit(True)
        for key, v in zip(keys, values):
            here &= F.col(key).isNull() if v == NULL_FOLDER else F.col(key) == F.lit(v).cast(rows.schema[key].dataType)
        out |= here
    return out


def touched_rows(target: DataFrame, batch: DataFrame, by: str) -> DataFrame:
    """Rows of the partitions of ``target`` that ``batch`` has rows for; the filter is literal, so folders are pruned."""
    values = [r[0] for r in batch.select(by).distinct().orderBy(by).collect()]
    known = [F.lit(v).cast(target.schema[by].dataType) for v in values if v is not None]
    chosen = F.col(by).isin(known) if known else F.lit(False)
    return target.where(chosen | F.col(by).isNull() if None in values else chosen)


def upsert_partitions(
    spark: SparkSession, path: str, schema: T.StructType, batch: DataFrame, keys: Sequence[str], by: str
) -> None:
    """Upsert ``batch`` into a table partitioned by ``by``, reading and rewriting only the partitions it touches.

    A key must not move between partitions. Rows of ``batch`` replace those of equal ``keys``;
    applied twice, a batch changes nothing. The first batch makes the table.
    """
    fresh = materialize(batch.select(*schema.names), "batch")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
    if exists:
        old = touched_rows(spark.read.schema(schema).parquet(path), fresh, by)
        fresh = materialize(upsert_rows(old, fresh, [by, *keys]), "merged")
    fresh.hint("rebalance", by).write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
