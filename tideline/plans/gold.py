"""The wide daily table: full refresh and idempotent append."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.cleanse import history_floor
from tideline.operators.metrics import add_norm, add_returns, add_volatility, add_zscore, pair_correlation
from tideline.operators.panel import densify, fill_forward, keep_weekdays, map_series, with_gap
from tideline.operators.resolve import keep_preferred, union_all
from tideline.plans.carry import Store, append, rebuild, strongest
from tideline.schemas import (
    ASSET_CLASSES,
    BASE_COLUMNS,
    CORRELATION_PAIRS,
    HISTORY_FLOOR,
    MACRO_COLUMNS,
    METRIC_PREFIX,
    PRICE_GAPS,
    SILVER_CRYPTO,
    SILVER_MACRO,
    SILVER_PRICES,
    VOL_7D,
    VOL_30D,
    ZSCORE_COLUMNS,
    gold_schema,
    inline_rows,
    series_dimension,
    series_rows,
)
from tideline.session import materialize
from tideline.sinks.lake import write_published
from tideline.sources.lake import scan_layer, scan_macro


PUBLISHED = "macro_market_merged"


@dataclass(frozen=True)
class GoldOptions:
    """Choices where more than one reading of the source data is defensible.

    return_fill     "pad" counts a gap day as a zero return, "none" as unknown
    fill_first      forward-fill before weekends are dropped, so that a macro
                    value dated on a weekend is not lost
    strict_sources  one source per column instead of falling back by date
    """

    return_fill: str = "pad"
    fill_first: bool = False
    strict_sources: bool = False


def curated_panel(
    prices: DataFrame,
    crypto: DataFrame,
    macro: DataFrame,
    floor: str | None = HISTORY_FLOOR,
    strict_sources: bool = False,
) -> DataFrame:
    """Silver rows to one (series, date, value) row per curated column and day.

    Every version of a source's row folds to the newest; where two sources feed
    one column the preferred one that has a value wins per date.
    """
    return strongest(curated_rows(prices, crypto, macro, floor, strict_sources)).select("series", "date", "value")


def curated_rows(
    prices: DataFrame,
    crypto: DataFrame,
    macro: DataFrame,
    floor: str | None = HISTORY_FLOOR,
    strict_sources: bool = False,
) -> DataFrame:
    """Silver rows of curated columns, with the source's priority and the row's version."""
    spark = prices.sparkSession
    rows = union_all([
        prices.select(
            "date", F.lit("yfinance").alias("source"), F.col("ticker").alias("series_id"),
            F.col("close").alias("value"), "transform_timestamp",
        ),
        crypto.select(
            "date", F.lit("cryptocompare").alias("source"), F.col("ticker").alias("series_id"),
            F.col("close").alias("value"), "transform_timestamp",
        ),
        macro.select(
            "date", F.col("data_source").alias("source"), F.col("indicator").alias("series_id"),
            "value", "transform_timestamp",
        ),
    ])
    if floor is not None:
        rows = history_floor(rows, floor)
    known = sorted({row[1] for row in series_rows()})
    dimension = series_dimension(spark)
    if strict_sources:
        dimension = keep_preferred(dimension, ["series"], "priority", ["series_id"])
    return map_series(rows, dimension, "series_id", known).select(
        "series", "date", "value", "priority", F.col("transform_timestamp").alias("version")
    )


def daily_grid(
    panel: DataFrame,
    calendar: DataFrame | None = None,
    filled: list[str] | None = None,
    fill_first: bool = False,
) -> DataFrame:
    """Weekday calendar for every series, slow series forward-filled."""
    slow = F.col("series").isin(MACRO_COLUMNS if filled is None else filled)
    if fill_first:
        return keep_weekdays(fill_forward(densify(panel, calendar=calendar), only=slow))
    weekdays = None if calendar is None else keep_weekdays(calendar)
    return fill_forward(densify(keep_weekdays(panel), calendar=weekdays), only=slow)


def _cell(series: str, field: str, name: str) -> Column:
    return F.expr(f"max(CASE WHEN series = '{series}' THEN {field} END) AS {name}")


def wide_table(grid: DataFrame, return_fill: str = "pad") -> DataFrame:
    """Metrics per series, then one grouping by date into the fixed 96 columns.

    The dense grid is written once; each set of metrics reads its own series from it.
    """
    spark = grid.sparkSession
    grid = materialize(grid, "grid")
    priced = grid.where(F.col("series").isin(list(METRIC_PREFIX)))
    metrics = materialize(priced.transform(add_returns, return_fill).transform(add_volatility).transform(add_norm), "metrics")
    scored = add_zscore(grid.where(F.col("series").isin(ZSCORE_COLUMNS)))
    plain = grid.where(~F.col("series").isin([*METRIC_PREFIX, *ZSCORE_COLUMNS]))
    pairs = inline_rows(
        spark,
        [(name, a, b) for name, (a, b) in CORRELATION_PAIRS.items()],
        "pair string, left_series string, right_series string",
    )
    paired = sorted({s for pair in CORRELATION_PAIRS.values() for s in pair})
    returns = metrics.select("series", "date", "ret").where(F.col("series").isin(paired))
    corr = pair_correlation(returns, pairs).select(
        F.col("pair").alias("series"), "date", F.col("corr").alias("value")
    )
    rows = union_all([metrics, scored, plain, corr])
    cells = [_cell(c, "value", c) for c in BASE_COLUMNS]
    for column, prefix in METRIC_PREFIX.items():
        fields = ["ret", "norm"]
        fields += ["vol_7d", "vol_7d_annualized"] if prefix in VOL_7D else []
        fields += ["vol_30d"] if prefix in VOL_30D else []
        cells += [_cell(column, field, f"{prefix}_{field}") for field in fields]
    cells += [_cell(c, "z", f"{c}_z") for c in ZSCORE_COLUMNS]
    cells += [_cell(name, "value", name) for name in CORRELATION_PAIRS]
    wide = rows.groupBy("date").agg(*cells)
    for prefix, (left, right) in PRICE_GAPS.items():
        wide = with_gap(wide, left, right, f"{prefix}_price_diff", f"{prefix}_price_diff_pct")
    return wide.select(*gold_schema().names)


def build_gold(
    panel: DataFrame, options: GoldOptions = GoldOptions(), calendar: DataFrame | None = None
) -> DataFrame:
    """Panel to published table.

    The panel is written once and read by every branch. The result depends on
    that copy only, so it may be published over the table it was built from.
    """
    stored = materialize(panel, "panel")
    if calendar is not None:
        calendar = materialize(calendar, "calendar")
    grid = daily_grid(stored, calendar, fill_first=options.fill_first)
    return wide_table(grid, options.return_fill)


def _silver(spark: SparkSession, root: str, day: dt.date | str | None) -> tuple[DataFrame, ...]:
    return (
        scan_layer(spark, root, "transformed", SILVER_PRICES, "yfinance", ASSET_CLASSES, day=day),
        scan_layer(spark, root, "transformed", SILVER_CRYPTO, "cryptocompare", ["crypto"], day=day),
        scan_macro(spark, root, "transformed", SILVER_MACRO, day=day),
    )


def gold_store(root: str) -> Store:
    """Where the wide table keeps its observations, carried state and rows by month."""
    return Store(f"{root.rstrip('/')}/curated/{PUBLISHED}_state", gold_schema())


def full_refresh(spark: SparkSession, root: str, options: GoldOptions = GoldOptions()) -> DataFrame:
    """The wide table from all historical and daily silver rows, which also become the state of later appends."""
    rows = curated_rows(*_silver(spark, root, None), strict_sources=options.strict_sources)
    return rebuild(spark, gold_store(root), rows, lambda panel: build_gold(panel, options))


def append_day(
    spark: SparkSession, root: str, day: dt.date | str, options: GoldOptions = GoldOptions()
) -> DataFrame:
    """The wide table after the silver rows that landed for one more day.

    Reads that day, the carried state and the look-back, not the history, and
    gives the rows of a full refresh, also for a day in the past or a weekend.
    Options must be those the table was made with. Without a state, as
    beside a table published by other means, this is a full refresh.
    """
    store = gold_store(root)
    if not store.months(spark):
        return full_refresh(spark, root, options)
    rows = curated_rows(*_silver(spark, root, day), strict_sources=options.strict_sources)
    return append(spark, store, rows, lambda panel: build_gold(panel, options))


def run_gold(
    spark: SparkSession,
    root: str,
    day: dt.date | str | None = None,
    options: GoldOptions = GoldOptions(),
) -> DataFrame:
    """Refresh the published table, or append ``day`` to it, and return it as published."""
    gold = full_refresh(spark, root, options) if day is None else append_day(spark, root, day, options)
    parquet, _ = write_published(gold, root, PUBLISHED)
    return spark.read.schema(gold_schema()).parquet(parquet)
