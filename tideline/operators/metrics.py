"""Derived metrics over a dense (series, date, value) panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.timeseries import (
    annualize,
    base_100,
    by_series,
    drawdown,
    pct_change,
    rolling_std,
)
from tideline.operators.panel import align_pairs
from tideline.operators.rolling import correlation_of, trailing_moments, zscore_of
from tideline.schemas import FRAME_CORRELATION, FRAME_VOL_LONG, FRAME_VOL_SHORT, FRAME_ZSCORE


def add_returns(dense: DataFrame, fill: str = "pad") -> DataFrame:
    return dense.withColumn("ret", pct_change("value", by_series(), fill))


def add_volatility(returns: DataFrame) -> DataFrame:
    """Short window plain and annualised, long window annualised."""
    w = by_series()
    return (
        returns.withColumn("vol_7d", rolling_std("ret", w, *FRAME_VOL_SHORT))
        .withColumn("vol_7d_annualized", annualize("vol_7d"))
        .withColumn("vol_30d", annualize(rolling_std("ret", w, *FRAME_VOL_LONG)))
    )


def add_norm(dense: DataFrame) -> DataFrame:
    return dense.withColumn("norm", base_100("value", by_series()))


def add_zscore(dense: DataFrame) -> DataFrame:
    rows, least = FRAME_ZSCORE
    with_moments = trailing_moments(dense, rows, "value", out="_m")
    return with_moments.withColumn("z", zscore_of(F.col("value"), F.col("_m"), least)).drop("_m")


def add_metrics(dense: DataFrame, fill: str = "pad") -> DataFrame:
    """Every per-series metric. All windows share one partitioning by series."""
    return dense.transform(add_returns, fill).transform(add_volatility).transform(add_norm).transform(
        add_zscore
    )


def pair_correlation(returns: DataFrame, pairs: DataFrame, value: str = "ret") -> DataFrame:
    """Rolling correlation per (pair, date)."""
    rows, least = FRAME_CORRELATION
    aligned = align_pairs(returns, pairs, value)
    moments = trailing_moments(aligned, rows, "x", "y", keys=["pair"], out="_m")
    return moments.select("pair", "date", correlation_of(F.col("_m"), least).alias("corr"))


def add_drawdown(panel: DataFrame) -> DataFrame:
    return panel.withColumn("drawdown", drawdown("value", by_series()))
