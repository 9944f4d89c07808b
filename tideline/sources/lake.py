"""Scans of the layered Parquet lake.

Layout below a root folder, as Hive-style keys::

    <layer>/asset_class=A/source=S[/provider=P]/load_type=historical
    <layer>/asset_class=A/source=S[/provider=P]/load_type=daily/year=Y/month=M/day=D

The folder depth differs between sources and load types, so a scan names the
prefixes it needs. Only those are listed, which on a large lake is cheaper than
discovering every partition and pruning afterwards. Where any asset class or
provider may have been landed, their folders alone are listed first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.resolve import union_all
from tideline.schemas import ASSET_CLASSES, BASE_COLUMNS, conform, conform_landed
from tideline.sources.census import file_census, groups_by_schema, source_file

LOAD_TYPES = ["historical", "daily"]


def prefix(
    root: str,
    layer: str,
    asset_class: str,
    source: str,
    load_type: str,
    provider: str | None = None,
    day: dt.date | str | None = None,
) -> str:
    keys = [f"asset_class={asset_class}", f"source={source}"]
    if provider:
        keys.append(f"provider={provider}")
    keys.append(f"load_type={load_type}")
    if day is not None:
        d = dt.date.fromisoformat(str(day))
        keys += [f"year={d.year:04d}", f"month={d.month:02d}", f"day={d.day:02d}"]
    return "/".join([root.rstrip("/"), layer, *keys])


def landed_keys(
    spark: SparkSession, root: str, layer: str, source: str, asset_class: str | None = None, providers: bool = False
) -> list[str]:
    """Asset classes that have a folder of ``source``, or the providers below one of them."""
    above = f"{root.rstrip('/')}/{layer}/asset_class="
    found = f"{asset_class}/source={source}/provider=*" if providers else f"*/source={source}"
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(above + found)
    files = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    folders = [f.getPath() for f in files.globStatus(pattern) or [] if f.isDirectory()]
    names = [(p if providers else p.getParent()).getName() for p in folders]
    return sorted(name.split("=", 1)[1] for name in names)


def unescaped(spark: SparkSession, key: str) -> str:
    """Value of a folder key, as Spark's writer escapes some characters in it."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(key)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def from_nanoseconds(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Turn integer nanoseconds into timestamps where ``schema`` expects a time.

    Spark has no nanosecond type; such columns are read as integers and reduced
    inside the scan's projection, so nothing is routed through the driver.
    """
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    found = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        f.name: F.timestamp_micros(F.expr(f"`{f.name}` div 1000")).cast("timestamp_ntz")
        for f in schema.fields
        if isinstance(f.dataType, times) and isinstance(found.get(f.name), T.LongType)
    })


def _has_files(spark: SparkSession, path: str) -> bool:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return not files.select("path").isEmpty()


def _landed_frames(
    spark: SparkSession, reader: DataFrameReader, path: str, tolerate_corrupt: bool, census: DataFrame | None
) -> list[DataFrame]:
    """One frame per group of files whose types agree below ``path``.

    Columns that come and go are merged by Spark, which reads the footers in
    parallel. Where files disagree on a type (another time unit, a volume with
    gaps), a census of their footers puts files of one schema in one scan.
    """
    if census is None:
        try:
            return [reader.option("mergeSchema", "true").parquet(path)]
        except Py4JJavaError as err:  # thrown by the merging job, which PySpark does not convert
            if "Failed merging schema" not in str(err.java_exception):
                raise
        census = file_census(spark, path)
    if not tolerate_corrupt:
        bad = [r.path for r in census.where("problem IS NOT NULL").select("path").limit(5).collect()]
        if bad:
            raise ValueError(f"files that cannot be read: {bad}")
    plain = reader.option("mergeSchema", "false")
    return [plain.schema(schema).parquet(*files) for schema, files in groups_by_schema(census, plain)]


def scan_prefix(
    spark: SparkSession,
    base: str,
    path: str,
    schema: T.StructType,
    tolerate_corrupt: bool = False,
    landed: bool = False,
    skip_unreadable: bool = False,
    census: DataFrame | None = None,
    file_column: str | None = None,
) -> DataFrame | None:
    """Every Parquet file below ``path``, or None when there is no such file.

    The fixed schema spares the inference job, keeps column pruning and filters
    effective, and yields NULL for columns a file does not have. ``landed``
    files, written by other tools, are read with their own types instead and
    converted, nanosecond timestamps included. Landed files of which none can be
    read are an error unless ``skip_unreadable``. With a ``census`` of the files
    their schemas are taken from it; ``file_column`` names a column for the file of each row.
    """
    reader = (
        spark.read.option("basePath", base)
        .option("pathGlobFilter", "*.parquet")
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", str(tolerate_corrupt).lower())
    )
    if landed:
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        frames = (
            _landed_frames(spark, reader, path, tolerate_corrupt, census) if landed else [reader.schema(schema).parquet(path)]
        )
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        if err.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            if skip_unreadable or not _has_files(spark, path):
                return None
            raise ValueError(f"{path}: files found but none could be read") from err
        raise
    if not frames:
        return None
    fixed = schema
    if file_column is not None:
        frames = [frame.withColumn(file_column, source_file()) for frame in frames]
        fixed = T.StructType([*schema.fields, T.StructField(file_column, T.StringType())])
    if not landed:
        return conform(frames[0], fixed)
    return union_all([conform_landed(from_nanoseconds(frame, fixed), fixed) for frame in frames])


def find_layer(
    spark: SparkSession,
    root: str,
    layer: str,
    schema: T.StructType,
    source: str,
    asset_classes: Sequence[str] | None = ASSET_CLASSES,
    load_types: Sequence[str] = LOAD_TYPES,
    providers: Sequence[str | None] | None = (None,),
    day: dt.date | str | None = None,
    tolerate_corrupt: bool = False,
    landed: bool = False,
    skip_unreadable: bool = False,
    with_keys: bool = False,
) -> DataFrame | None:
    """Union of the named prefixes; ``day`` narrows the daily ones to one folder.

    Without ``asset_classes`` all that the source has are read; without
    ``providers`` all below each class and the flat folder.
    Prefixes that do not exist are skipped; None when there are none at all.
    ``with_keys`` sets asset_class and provider from the prefix of each row.
    """
    base = f"{root.rstrip('/')}/{layer}"
    types = ["daily"] if day is not None else load_types
    frames = []
    for asset_class in landed_keys(spark, root, layer, source) if asset_classes is None else asset_classes:
        named = [*landed_keys(spark, root, layer, source, asset_class, providers=True), None] if providers is None else providers
        for provider in named:
            for load_type in types:
                path = prefix(root, layer, asset_class, source, load_type, provider, day)
                frame = scan_prefix(
                    spark, base, path, schema, tolerate_corrupt, landed, skip_unreadable
                )
                if frame is None:
                    continue
                if with_keys:
                    keys = {"asset_class": asset_class, "provider": provider}
                    frame = frame.withColumns({
                        k: F.lit(None if v is None else unescaped(spark, v)).cast("string") for k, v in keys.items()
                    })
                frames.append(frame)
    return union_all(frames) if frames else None


def scan_layer(spark: SparkSession, root: str, layer: str, schema: T.StructType, *args, **kwargs) -> DataFrame:
    """As :func:`find_layer`, with an empty frame of the right schema in place of None."""
    found = find_layer(spark, root, layer, schema, *args, **kwargs)
    return empty(spark, schema) if found is None else found


def scan_macro(
    spark: SparkSession,
    root: str,
    layer: str,
    schema: T.StructType,
    load_types: Sequence[str] = LOAD_TYPES,
    day: dt.date | str | None = None,
    asset_classes: Sequence[str] | None = ("economic",),
) -> DataFrame:
    """Both macro sources, one of them with per-provider and flat folders, tagged by origin.

    The wide table is made of the economic class; without ``asset_classes`` all are read.
    """
    frames = [
        scan_layer(spark, root, layer, schema, source, asset_classes, load_types, providers, day)
        .withColumn("data_source", F.lit(source))
        for source, providers in (("fred", [None]), ("dbnomics", None))
    ]
    return union_all(frames)


def checked_key(key: str, suffix: str) -> str:
    """Normalised object key, refused unless it ends in ``suffix``."""
    key = key.strip().lstrip("/").rstrip(".")
    if not key.lower().endswith(suffix):
        raise ValueError(f"expected a {suffix} key, got {key!r}")
    return key


def scan_published(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The published wide table from Parquet."""
    return spark.read.parquet(f"{root.rstrip('/')}/{checked_key(key, '.parquet')}")


def scan_published_csv(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The published wide table from CSV, all text; see ``cleanse_csv`` for the types."""
    return (
        spark.read.option("header", "true")
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .csv(f"{root.rstrip('/')}/{checked_key(key, '.csv')}")
    )


def base_columns_only(gold: DataFrame) -> DataFrame:
    """Published table without its derived columns, ready to be recomputed."""
    return gold.select(
        F.to_date("date").alias("date"), *[c for c in BASE_COLUMNS if c in gold.columns]
    )
