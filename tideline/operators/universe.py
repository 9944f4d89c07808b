"""Instrument universes: which symbols and coins are worth loading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import is_valid_ticker
from tideline.operators.resolve import first_per_key
from tideline.schemas import (
    DOLLAR_VOLUME_TIERS,
    EXCHANGE_ORDER,
    EXCLUDED_COINS,
    MIN_COIN_VOLUME,
    MIN_DOLLAR_VOLUME,
)


def listed_symbols(rows: DataFrame) -> DataFrame:
    """Valid symbols of all exchanges; a later exchange overrides an earlier one.

    ``rows``: symbol, name, exchange. Within one exchange the greater name wins,
    so the pick does not depend on file order.
    """
    rank = F.lit(0)
    for exchange, position in EXCHANGE_ORDER.items():
        rank = F.when(F.upper("exchange") == exchange, F.lit(position)).otherwise(rank)
    tidy = rows.select(
        F.trim("symbol").alias("symbol"),
        F.trim("name").alias("name"),
        F.upper("exchange").alias("exchange"),
        rank.alias("_order"),
    ).where((F.col("symbol") != "") & is_valid_ticker("symbol"))
    picked = first_per_key(
        tidy,
        ["symbol"],
        [F.col("_order").desc(), F.col("exchange").desc(), F.col("name").desc_nulls_last()],
    )
    return picked.drop("_order")


def last_quotes(weekly: DataFrame) -> DataFrame:
    """Last known close and last known weekly volume per symbol.

    ``weekly``: symbol, date, close, volume.
    """
    quoted = F.when(F.col("close").isNotNull(), F.col("date"))
    traded = F.when(F.col("volume").isNotNull(), F.col("date"))
    return weekly.groupBy("symbol").agg(
        F.max_by("close", quoted).alias("close"), F.max_by("volume", traded).alias("weekly_volume")
    )


def dollar_volumes(quotes: DataFrame) -> DataFrame:
    """Price, mean daily volume and dollar volume of quoted, traded symbols."""
    daily = F.col("weekly_volume").cast("bigint") / F.lit(5)
    return quotes.where((F.col("close") > 0) & (F.col("weekly_volume") > 0)).select(
        "symbol",
        F.round("close", 2).alias("price"),
        daily.cast("bigint").alias("avg_volume"),
        F.round(F.col("close") * daily, 2).alias("dollar_volume"),
    )


def liquid_universe(
    symbols: DataFrame, volumes: DataFrame, threshold: float = MIN_DOLLAR_VOLUME
) -> DataFrame:
    """Listed symbols whose dollar volume reaches the threshold."""
    return symbols.join(volumes.where(F.col("dollar_volume") >= threshold), "symbol")


def ranked(universe: DataFrame) -> DataFrame:
    return universe.orderBy(F.col("dollar_volume").desc(), F.col("symbol"))


def top_symbols(universe: DataFrame, n: int = 10) -> DataFrame:
    return ranked(universe).limit(n)


def count_by_exchange(universe: DataFrame) -> DataFrame:
    return universe.groupBy("exchange").agg(F.count("*").alias("stocks"))


def count_by_tier(universe: DataFrame) -> DataFrame:
    """Stocks per half-open dollar-volume tier, every tier present, in one pass."""
    v = F.col("dollar_volume")
    tests = [
        (v >= low) if high is None else ((v >= low) & (v < high))
        for _, low, high in DOLLAR_VOLUME_TIERS
    ]
    counts = universe.agg(*[F.count_if(t).alias(f"_{i}") for i, t in enumerate(tests)])
    rows = F.array(*[
        F.struct(F.lit(name).alias("tier"), F.col(f"_{i}").alias("stocks"))
        for i, (name, _, _) in enumerate(DOLLAR_VOLUME_TIERS)
    ])
    return counts.select(F.inline(rows))


def coin_universe(
    markets: DataFrame, threshold: float = MIN_COIN_VOLUME, excluded: Sequence[str] = EXCLUDED_COINS
) -> DataFrame:
    """Traded coins, without stable and wrapped ones, shaped for both price sources."""
    symbol = F.upper(F.coalesce("symbol", F.lit("")))
    return markets.where(
        (F.coalesce("total_volume", F.lit(0.0)) >= threshold) & ~symbol.isin(*excluded)
    ).select(
        F.col("id").alias("coingecko_id"),
        symbol.alias("symbol"),
        "name",
        F.concat(symbol, F.lit("-USD")).alias("yahoo_symbol"),
        symbol.alias("cryptocompare_symbol"),
        "market_cap",
        "market_cap_rank",
        F.col("total_volume").alias("total_volume_24h"),
        "current_price",
        "last_updated",
    )


def top_coins(coins: DataFrame, n: int = 20) -> DataFrame:
    return coins.orderBy(F.col("total_volume_24h").desc_nulls_last(), "coingecko_id").limit(n)


def universe_header(universe: DataFrame, threshold: float, generated_at: str) -> DataFrame:
    """The one-row header that accompanies a published universe."""
    return universe.agg(F.count("*").alias("total_count")).select(
        F.lit(generated_at).alias("generated_at"),
        "total_count",
        F.lit(float(threshold)).alias("min_dollar_volume_threshold"),
        F.array(*[F.lit(e) for e in EXCHANGE_ORDER]).alias("exchanges"),
    )
