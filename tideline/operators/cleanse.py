"""Row-level cleaning: bronze rows to conformed silver rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import cleanse_number, date_parts, nan_to_null, snake_name
from tideline.schemas import SILVER_CRYPTO, SILVER_MACRO, SILVER_PRICES, conform

PRICE_FIELDS = ["open", "high", "low", "close"]


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that exist and whose new name is still free."""
    taken = set(df.columns)
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in taken and b not in taken})


def null_nans(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    floating = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({name: nan_to_null(name) for name in floating})


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def snake_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_name(c) for c in df.columns])


def history_floor(df: DataFrame, floor: str, column: str = "date") -> DataFrame:
    return df.where(F.col(column) >= F.lit(floor).cast(df.schema[column].dataType))


def clip_dates(
    df: DataFrame, start: str | None = None, end: str | None = None, column: str = "date"
) -> DataFrame:
    """Inclusive date range; either side may be open."""
    dtype = df.schema[column].dataType
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast(dtype))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast(dtype))
    return df


def drop_empty_bars(df: DataFrame) -> DataFrame:
    """Drop rows whose open, high, low and close are all NULL."""
    return df.dropna(how="all", subset=PRICE_FIELDS)


def valid_bars(df: DataFrame) -> DataFrame:
    """Quoted, positive and consistent bars; an unknown high or low drops the row."""
    return df.where(
        F.col("close").isNotNull() & (F.col("close") > 0) & (F.col("high") >= F.col("low"))
    )


def with_lineage(
    df: DataFrame,
    asset_class: str | None,
    source: str,
    load_type: str,
    transform_timestamp: Column | None = None,
    provider: str | None = None,
) -> DataFrame:
    """Date parts, layout keys and the audit stamp.

    Without ``asset_class`` or ``provider`` the rows keep the ones they carry.

    Pass ``transform_timestamp`` for reproducible output; the default is the
    one query-wide current time.
    """
    year, month, day = date_parts("date")
    columns = {
        "year": year,
        "month": month,
        "day": day,
        "source": F.lit(source),
        "load_type": F.lit(load_type),
        "transform_timestamp": F.current_timestamp()
        if transform_timestamp is None
        else transform_timestamp,
    }
    if asset_class is not None:
        columns["asset_class"] = F.lit(asset_class)
    if provider is not None:
        columns["provider"] = F.lit(provider)
    return df.withColumns(columns)


def silver_prices(
    bronze: DataFrame,
    asset_class: str | None,
    load_type: str,
    floor: str | None = None,
    transform_timestamp: Column | None = None,
) -> DataFrame:
    """Daily bars: quality filter, four-decimal prices, fixed sixteen columns."""
    df = rename_present(bronze, {"adj_close": "adjusted_close"})
    df = null_nans(df.withColumn("date", F.to_date("date")))
    if floor is not None:
        df = history_floor(df, floor)
    df = valid_bars(df)
    rounded = [c for c in PRICE_FIELDS + ["adjusted_close"] if c in df.columns]
    df = df.withColumns({c: F.round(c, 4) for c in rounded})
    df = with_lineage(df, asset_class, "yfinance", load_type, transform_timestamp)
    return conform(df, SILVER_PRICES)


def silver_crypto(
    bronze: DataFrame,
    asset_class: str | None,
    load_type: str,
    process_date: str | None = None,
    transform_timestamp: Column | None = None,
) -> DataFrame:
    """Exchange bars: volume in USD and in coins; no quality filter, no rounding."""
    names = [c for c in ("ticker", "symbol") if c in bronze.columns]
    dates = [F.to_date("date")] if "date" in bronze.columns else []
    df = bronze.withColumn("ticker", F.coalesce(*names)) if names else bronze
    df = rename_present(df, {"volume_to": "volume", "volume_from": "volume_coin"})
    df = null_nans(df.withColumn("date", F.coalesce(*dates, F.lit(process_date).cast("date"))))
    df = with_lineage(df, asset_class, "cryptocompare", load_type, transform_timestamp)
    return conform(df, SILVER_CRYPTO)


def silver_macro(
    bronze: DataFrame,
    asset_class: str | None,
    source: str,
    load_type: str,
    provider: str | None = None,
    transform_timestamp: Column | None = None,
) -> DataFrame:
    """Indicator observations: known values only, optional columns as typed NULLs."""
    df = rename_present(bronze, {"series_id": "indicator"})
    df = null_nans(df.withColumn("date", F.to_date("date")))
    df = df.where(F.col("value").isNotNull())
    df = with_lineage(df, asset_class, source, load_type, transform_timestamp, provider)
    return conform(df, SILVER_MACRO)


def cleanse_csv(
    df: DataFrame, date_column: str = "date", null_columns: Sequence[str] = ()
) -> DataFrame:
    """All-text CSV rows to a date and doubles; ``null_columns`` are blanked."""
    df = lower_names(df)
    out = []
    for name in df.columns:
        if name == date_column:
            out.append(F.to_date(F.col(name)).alias(name))
        elif name in null_columns:
            out.append(F.lit(None).cast("double").alias(name))
        else:
            out.append(cleanse_number(F.col(f"`{name}`")).alias(name))
    return df.select(*out)
