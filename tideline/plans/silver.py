"""Bronze to silver for each source, as lake-to-lake jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.cleanse import silver_crypto, silver_macro, silver_prices
from tideline.schemas import (
    BRONZE_CRYPTO,
    BRONZE_MACRO,
    BRONZE_PRICES,
    HISTORY_FLOOR,
)
from tideline.sinks.lake import write_silver
from tideline.sources.lake import find_layer


def bronze_to_silver(
    spark: SparkSession,
    root: str,
    source: str,
    load_type: str,
    day: dt.date | str | None = None,
    transform_timestamp: Column | None = None,
) -> DataFrame | None:
    """Silver rows of every asset class landed for ``source``, as one plan.

    ``day`` restricts a daily load to one folder per class. None when nothing
    has been landed.
    """
    schema = {
        "yfinance": BRONZE_PRICES,
        "cryptocompare": BRONZE_CRYPTO,
        "fred": BRONZE_MACRO,
        "dbnomics": BRONZE_MACRO,
    }[source]
    bronze = find_layer(
        spark, root, "raw", schema, source, None, [load_type],
        None if source == "dbnomics" else [None], day,
        tolerate_corrupt=source in ("dbnomics", "cryptocompare"),
        skip_unreadable=source == "dbnomics", landed=True, with_keys=True,
    )
    if bronze is None:
        return None
    if source == "yfinance":
        floor = HISTORY_FLOOR if load_type == "historical" else None
        return silver_prices(bronze, None, load_type, floor, transform_timestamp)
    if source == "cryptocompare":
        process_date = None if day is None else str(day)
        return silver_crypto(bronze, None, load_type, process_date, transform_timestamp)
    return silver_macro(bronze, None, source, load_type, None, transform_timestamp)


def run_silver(
    spark: SparkSession, root: str, source: str, load_type: str, day: dt.date | str | None = None
) -> int:
    """Refine what has been landed for ``source`` and return the rows written."""
    rows = bronze_to_silver(spark, root, source, load_type, day)
    if rows is None:
        return 0
    if source != "dbnomics":
        return write_silver(rows, root, load_type)
    # rows of a named provider go to its folder, the others to the flat one
    named = F.col("provider").isNotNull()
    return write_silver(rows.where(named), root, load_type, provider=True) + write_silver(
        rows.where(~named), root, load_type
    )
