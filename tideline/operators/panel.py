"""Long (series, date, value) panels: build, align on a calendar, widen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import is_weekday
from tideline.functions.timeseries import by_series, ffill
from tideline.operators.resolve import union_all


def daily_bars(
    ticks: DataFrame, series: Column | str, ts: Column | str, price: Column | str, tie: Column | str
) -> DataFrame:
    """Open, high, low, close and count per series and day.

    Only combinable aggregates, so ticks are reduced before the shuffle.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = ticks.select(
        col(series).alias("series"),
        F.to_date(col(ts)).alias("date"),
        col(price).alias("_p"),
        F.struct(col(ts).alias("ts"), col(tie).alias("tie")).alias("_o"),
    )
    return rows.groupBy("series", "date").agg(
        F.min_by("_p", "_o").alias("open"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"),
        F.count("*").alias("volume"),
    )


def map_series(
    rows: DataFrame,
    dimension: DataFrame,
    id_column: str,
    known_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Keep mapped series and attach their curated name.

    ``known_ids`` (the fixed mapping) becomes an ``IN`` filter the Parquet scan
    can use. The join itself carries no hint: Spark broadcasts the dimension
    while its measured size stays under the broadcast threshold and otherwise
    shuffles, splitting a hot identifier through adaptive skew handling.
    """
    if known_ids is not None:
        rows = rows.where(F.col(id_column).isin(list(known_ids)))
    dim = dimension.withColumnRenamed("series_id", id_column)
    keys = [id_column] + (["source"] if "source" in dim.columns and "source" in rows.columns else [])
    if "source" not in keys and "source" in dim.columns:
        dim = dim.drop("source")
    return rows.join(dim, keys, "inner")


def keep_weekdays(df: DataFrame, column: str = "date") -> DataFrame:
    return df.where(is_weekday(column))


def calendar_array(panel: DataFrame) -> Column:
    """Sorted distinct dates of the panel as one scalar array.

    Bounded by the number of days in the covered span, not by the rows: each
    map task folds its rows into a set of days before anything is exchanged.
    """
    return panel.agg(F.sort_array(F.collect_set("date")).alias("dates")).scalar()


def densify(
    panel: DataFrame,
    values: Sequence[str] = ("value",),
    calendar: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Give every series a row on every calendar date, NULL where it has no value.

    The calendar is the set of dates of the whole panel, or of ``calendar``.
    ``panel`` must be unique on (series, date). Instead of joining a
    series-by-date grid back to the panel, each row is stretched over the
    calendar dates up to the next row of its series: the sparse panel is
    shuffled once, by series, and the dense rows are produced in place, already
    partitioned for the windows that follow. Columns in ``keep`` are constant
    per series and are repeated on the added rows.
    """
    cal = calendar_array(panel if calendar is None else calendar)
    one = panel.sparkSession.range(0, 1, 1, 1)
    days = one.select(cal.alias("dates")).select(F.posexplode("dates").alias("_at", "date"))
    w = by_series()
    placed = panel.join(days, "date", "inner").select(
        "series",
        *keep,
        F.col("date").alias("_own"),
        *values,
        F.when(F.lag("_at").over(w).isNull(), F.lit(0)).otherwise(F.col("_at")).alias("_from"),
        F.lead("_at").over(w).alias("_next"),
    )
    span = F.slice(
        F.col("_cal"), F.col("_from") + 1, F.coalesce(F.col("_next"), F.size("_cal")) - F.col("_from")
    )
    return placed.withColumn("_cal", cal).select(
        "series", *keep, "_own", *values, F.explode(span).alias("date")
    ).select(
        "series",
        *keep,
        "date",
        *[F.when(F.col("date") == F.col("_own"), F.col(v)).alias(v) for v in values],
    )


def fill_forward(dense: DataFrame, value: str = "value", only: Column | None = None) -> DataFrame:
    """Forward-fill within each series; ``only`` restricts it to some series."""
    filled = ffill(value, by_series())
    if only is not None:
        filled = F.when(only, filled).otherwise(F.col(value))
    return dense.withColumn(value, filled)


def pivot_wide(
    panel: DataFrame, columns: Sequence[str], key: str = "date", name: str = "series", value: str = "value"
) -> DataFrame:
    """One column per listed series. The fixed list keeps the schema static.

    Conditional aggregates over one grouping: a single shuffle of partially
    aggregated rows. The panel is unique per (key, name), so ``max`` only drops
    the NULLs of the other columns.
    """
    return panel.groupBy(key).agg(
        *[F.max(F.when(F.col(name) == c, F.col(value))).alias(c) for c in columns]
    )


def unpivot_grid(
    wide: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "series", value: str = "value"
) -> DataFrame:
    """Wide grid to long rows, NULL cells dropped."""
    return wide.unpivot(list(ids), list(columns), name, value).where(F.col(value).isNotNull())


def grid_to_bars(grid: DataFrame, tickers: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Landed ``<ticker>|<field>`` grid to one bar row per (date, ticker).

    One pass: each input row is expanded to one struct per ticker, and bars
    with no price at all are dropped.
    """
    bars = F.array(*[
        F.struct(
            F.lit(t).alias("ticker"),
            *[F.col(f"`{t}|{f}`").alias(f) for f in fields],
        )
        for t in tickers
    ])
    rows = grid.select("date", F.inline(bars))
    priced = [f for f in fields if f in ("open", "high", "low", "close")]
    return rows.dropna(how="all", subset=priced)


def outer_merge(panels: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Full outer merge by date of panels with disjoint series.

    Equal to chained full joins on the pivoted frames, with one shuffle for
    any number of inputs and no hot join key.
    """
    return pivot_wide(union_all(panels), columns)


def align_pairs(panel: DataFrame, pairs: DataFrame, value: str = "value") -> DataFrame:
    """(pair, date, x, y) for each row of ``pairs`` (pair, left_series, right_series)."""
    sides = pairs.select(
        "pair",
        F.explode(F.array(
            F.struct(F.col("left_series").alias("series"), F.lit(True).alias("_left")),
            F.struct(F.col("right_series").alias("series"), F.lit(False).alias("_left")),
        )).alias("_side"),
    ).select("pair", "_side.*")
    return (
        panel.join(sides, "series")
        .groupBy("pair", "date")
        .agg(
            F.max(F.when(F.col("_left"), F.col(value))).alias("x"),
            F.max(F.when(~F.col("_left"), F.col(value))).alias("y"),
        )
    )


def price_gap(
    panel: DataFrame, left: str, right: str, name: str = "series", value: str = "value"
) -> DataFrame:
    """Difference of two quotes of one asset by date, absolute and in percent of the first."""
    both = pivot_wide(panel.where(F.col(name).isin(left, right)), [left, right], name=name, value=value)
    return with_gap(both, left, right, "diff", "diff_pct")


def with_gap(wide: DataFrame, left: str, right: str, diff: str, pct: str) -> DataFrame:
    gap = F.col(left) - F.col(right)
    return wide.withColumns({
        diff: gap,
        pct: F.try_divide(gap, F.col(left)) * 100,
    })
