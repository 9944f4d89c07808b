"""Landed API payloads to bronze rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import (
    nan_to_null,
    pair_symbol,
    parse_number,
    parse_period,
    series_id_parts,
    unix_date,
)
from tideline.operators.cleanse import clip_dates
from tideline.schemas import CRYPTO_PAYLOAD, MACRO_PAYLOAD


def _fetched(fetch_timestamp: Column | None) -> Column:
    stamp = F.current_timestamp() if fetch_timestamp is None else fetch_timestamp
    return stamp.cast("string").alias("fetch_timestamp")


def macro_payload_rows(
    payloads: DataFrame,
    series_id: str = "series_id",
    payload: str = "payload",
    start: str | None = None,
    end: str | None = None,
    fetch_timestamp: Column | None = None,
) -> DataFrame:
    """Observations of one document per series: parallel period and value arrays.

    Only the first document of a payload counts. Identifiers of fewer than three
    parts, missing documents, empty arrays and unparsable rows give nothing.
    """
    parts = series_id_parts(series_id)
    doc = payloads.where(F.size(F.split(series_id, "/")) >= 3).select(
        F.col(series_id).alias("series_id"),
        F.try_element_at(F.from_json(payload, MACRO_PAYLOAD)["series"]["docs"], F.lit(1)).alias("_doc"),
        *[c.alias(n) for n, c in parts.items()],
    )
    rows = doc.where(F.size("_doc.period") == F.size("_doc.value")).select(
        "series_id",
        *parts,
        F.coalesce("_doc.series_name", F.lit("")).alias("series_name"),
        F.coalesce("_doc.@unit", "_doc.unit", F.lit("")).alias("unit"),
        F.coalesce("_doc.@frequency", "_doc.frequency", F.lit("")).alias("frequency"),
        F.inline(F.arrays_zip(
            F.col("_doc.period").alias("period"), F.col("_doc.value").alias("raw")
        )),
    )
    typed = rows.select(
        parse_period("period").alias("date"),
        parse_number("raw").alias("value"),
        "series_id",
        *parts,
        "series_name",
        "unit",
        "frequency",
        F.lit("dbnomics").alias("source"),
        _fetched(fetch_timestamp),
    ).dropna(subset=["date", "value"])
    return clip_dates(typed, start, end)


def crypto_payload_rows(
    payloads: DataFrame,
    ticker: str = "ticker",
    payload: str = "payload",
    start: str | None = None,
    end: str | None = None,
    fetch_timestamp: Column | None = None,
) -> DataFrame:
    """Daily bars of successful exchange responses, clipped to the window."""
    parsed = payloads.select(
        F.col(ticker).alias("ticker"), F.from_json(payload, CRYPTO_PAYLOAD).alias("_p")
    ).where(F.col("_p.Response") == "Success")
    bars = parsed.select("ticker", F.inline("_p.Data.Data"))
    rows = bars.select(
        unix_date("time").alias("date"),
        pair_symbol("ticker").alias("symbol"),
        F.lit("USD").alias("tsym"),
        *[nan_to_null(c).alias(c) for c in ("open", "high", "low", "close")],
        F.col("volumefrom").alias("volume_from"),
        F.col("volumeto").alias("volume_to"),
        _fetched(fetch_timestamp),
        "ticker",
    )
    return clip_dates(rows, start, end)


def observation_rows(
    landed: DataFrame, fetch_timestamp: Column | None = None
) -> DataFrame:
    """Plain (series_id, date, value) text observations, unknown values dropped."""
    return landed.select(
        "series_id",
        F.to_date("date").alias("date"),
        parse_number("value").alias("value"),
        _fetched(fetch_timestamp),
    ).dropna(subset=["value"])
