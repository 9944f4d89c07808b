"""Configuration documents listing what to load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.resolve import union_all
from tideline.schemas import COIN_MARKET, MIN_COIN_VOLUME


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, as text."""
    return spark.read.text(path, wholetext=True)


def listed_ids(documents: DataFrame, array: str, field: str, column: str = "value") -> DataFrame:
    """Distinct non-null ``field`` of every object in the top-level array ``array``.

    Serves stock lists (``stocks``/``symbol``), coin lists (``coins``/
    ``yahoo_symbol``) and asset lists (``assets``/``yahoo_finance`` or ``fred``).
    """
    schema = f"struct<`{array}`: array<struct<`{field}`: string>>>"
    parsed = documents.select(F.from_json(column, schema)[array].alias("_items"))
    ids = parsed.select(F.inline("_items")).select(F.col(f"`{field}`").alias("series_id"))
    return ids.where(F.col("series_id").isNotNull() & (F.col("series_id") != "")).distinct()


def flat_list_ids(documents: DataFrame, section: str, name: str, column: str = "value") -> DataFrame:
    """Identifiers of a flat list nested one level deep."""
    schema = f"struct<`{section}`: struct<`{name}`: array<string>>>"
    parsed = documents.select(F.from_json(column, schema)[section][name].alias("_ids"))
    return parsed.select(F.explode("_ids").alias("series_id")).distinct()


def grouped_ids(documents: DataFrame, section: str, column: str = "value") -> DataFrame:
    """(group, series_id) of ``section.{group}.series[].id``; groups named ``_*`` are comments."""
    schema = f"struct<`{section}`: map<string, string>>"
    entries = documents.select(
        F.explode(F.from_json(column, schema)[section]).alias("group", "_body")
    ).where(~F.col("group").startswith("_"))
    body = F.from_json("_body", "struct<series: array<struct<id: string>>>")
    return entries.select("group", F.inline(body["series"])).select(
        "group", F.col("id").alias("series_id")
    ).where(F.col("series_id").isNotNull())


def read_coin_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed market pages, each a JSON array of coins."""
    return spark.read.schema(COIN_MARKET).option("multiLine", "true").json(path)


def coin_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed market pages as (page, coins): ``page=N`` folders of JSON arrays, most traded coins first."""
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in COIN_MARKET.fields)
    documents = spark.read.schema("value string, page int").text(path, wholetext=True)
    return documents.select("page", F.from_json("value", f"array<struct<{fields}>>").alias("coins"))


def until_below(pages: DataFrame, threshold: float = MIN_COIN_VOLUME) -> DataFrame:
    """Coins of the pages up to the first that is empty or holds a coin below the threshold, that page included.

    The number of that page is found first, by a minimum, and later pages are
    then pruned by their folders; no page waits for the one before it.
    """
    def low(coin):
        return F.coalesce(coin["total_volume"], F.lit(0.0)) < threshold

    stops = pages.where((F.size("coins") <= 0) | F.exists("coins", low))
    last = stops.agg(F.coalesce(F.min("page"), F.lit(2**31 - 1)).alias("last")).scalar()
    return pages.where(F.col("page") <= last).select("page", F.inline("coins"))


def read_listings(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Landed symbol files by exchange, each a JSON array of symbols and names."""
    return union_all([
        spark.read.schema("symbol string, name string")
        .option("multiLine", "true")
        .json(path)
        .withColumn("exchange", F.lit(exchange))
        for exchange, path in paths.items()
    ])
