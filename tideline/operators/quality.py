"""Reports and dashboard questions over panels and load logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import is_weekday, safe_divide
from tideline.functions.timeseries import by_series, ffill
from tideline.operators.metrics import add_drawdown
from tideline.schemas import inline_rows
from tideline.sinks.lake import observed


def span_report(df: DataFrame, column: str = "date") -> DataFrame:
    """First and last date, row and column count."""
    return df.agg(
        F.min(column).alias("first_date"),
        F.max(column).alias("last_date"),
        F.count("*").alias("row_count"),
    ).withColumn("column_count", F.lit(len(df.columns)))


def stage_counts(df: DataFrame, kept: Column, *keys: str) -> DataFrame:
    """Rows read, kept and removed by a filter, in the pass that reads them."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows_read"),
        F.count_if(kept).alias("rows_kept"),
        F.count_if(~F.coalesce(kept, F.lit(False))).alias("rows_removed"),
    )


def staged(df: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, dict[str, Observation]]:
    """Apply named stages; each one's rows are counted on their way, in the pass that uses the result.

    The counts are there once an action has run over all of the result.
    """
    seen = {"read": Observation("read")}
    df = df.observe(seen["read"], F.count(F.lit(1)).alias("rows"))
    for name, stage in stages:
        seen[name] = Observation(name)
        df = stage(df).observe(seen[name], F.count(F.lit(1)).alias("rows"))
    return df, seen


def stage_report(spark: SparkSession, seen: dict[str, Observation]) -> DataFrame:
    """Rows that came to each stage, went on, and were removed."""
    counts = [(name, observed(each, "rows")) for name, each in seen.items()]
    rows = [(k, name, before, now, before - now) for k, ((_, before), (name, now)) in enumerate(zip(counts, counts[1:]), 1)]
    return inline_rows(spark, rows, "position int, stage string, rows_read bigint, rows_kept bigint, rows_removed bigint")


def weekend_report(df: DataFrame, *keys: str) -> DataFrame:
    return stage_counts(df, is_weekday("date"), *keys)


def series_listing(df: DataFrame, series: str, *keys: str) -> DataFrame:
    """Number of distinct series, and their first and last identifier, per group."""
    return df.groupBy(*keys).agg(
        F.countDistinct(series).alias("series_count"),
        F.min(series).alias("first_series"),
        F.max(series).alias("last_series"),
    )


def records_per_date(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(F.count("*").alias("records"))


def max_drawdown(panel: DataFrame) -> DataFrame:
    return panel.transform(add_drawdown).groupBy("series").agg(F.min("drawdown").alias("max_drawdown"))


def performance(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Total return between the first and last quote inside the dates, ranked."""
    quoted = panel.where(
        F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & F.col("value").isNotNull()
    )
    ends = quoted.groupBy("series").agg(
        F.min_by("value", "date").alias("first_value"), F.max_by("value", "date").alias("last_value")
    )
    total = safe_divide("last_value", "first_value") - F.lit(1.0)
    return _ranked(ends.withColumn("total_return", total), "total_return")


def _ranked(df: DataFrame, column: str) -> DataFrame:
    """Rank (ties share, gaps follow) by ``column`` descending, as a two-level running count.

    Rows fold to one per distinct value, values are counted inside narrow value
    buckets in parallel, and only the bucket totals are ordered as a whole.
    """
    counts = (
        df.groupBy(column)
        .agg(F.count("*").alias("_n"))
        .withColumn("_bucket", F.round(column, 4))
    )
    before = (Window.unboundedPreceding, -1)
    totals = counts.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    by_bucket = Window.orderBy(F.col("_bucket").desc_nulls_last()).rowsBetween(*before)
    offsets = totals.select(
        F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(by_bucket), F.lit(0)).alias("_above")
    )
    inside = Window.partitionBy("_bucket").orderBy(F.col(column).desc()).rowsBetween(*before)
    placed = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ranks = placed.join(offsets, F.col("_bucket").eqNullSafe(F.col("_b"))).select(
        F.col(column).alias("_v"), (F.col("_above") + F.col("_ahead") + 1).alias("rank")
    )
    return df.join(ranks, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def correlation_matrix(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every two of the listed return columns over their common dates.

    All pairs are aggregates of one grouping-free pass; no row is paired with
    another row.
    """
    aggs, entries = [], []
    for i, (a, b) in enumerate(combinations(columns, 2)):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        aggs += [
            F.covar_samp(x, y).alias(f"_c{i}"),
            F.stddev_samp(x).alias(f"_x{i}"),
            F.stddev_samp(y).alias(f"_y{i}"),
            F.count(x).alias(f"_n{i}"),
        ]
        entries.append(F.struct(
            F.lit(a).alias("left_series"),
            F.lit(b).alias("right_series"),
            F.col(f"_n{i}").alias("pairs"),
            safe_divide(F.col(f"_c{i}"), F.col(f"_x{i}") * F.col(f"_y{i}")).alias("corr"),
        ))
    return wide.agg(*aggs).select(F.inline(F.array(*entries)))


def shock_days(metrics: DataFrame, k: float = 2.0) -> DataFrame:
    """Days whose absolute return exceeds ``k`` times the short rolling volatility."""
    return metrics.where(F.abs("ret") > F.lit(k) * F.col("vol_7d"))


def monthly_trend(panel: DataFrame) -> DataFrame:
    """Last known value per month with its change over one and twelve months.

    Months are stepped by calendar month, so a missing month is not skipped over.
    """
    monthly = panel.where(F.col("value").isNotNull()).groupBy(
        "series", F.trunc("date", "month").cast("date").alias("month")
    ).agg(F.max_by("value", "date").alias("value"))
    number = F.year("month") * 12 + F.month("month")
    w = Window.partitionBy("series").orderBy("_m")

    def back(months: int) -> Column:
        exact = w.rangeBetween(-months, -months)
        return safe_divide("value", F.max("value").over(exact)) - F.lit(1.0)

    return monthly.withColumn("_m", number).select(
        "series", "month", "value", back(1).alias("mom"), back(12).alias("yoy")
    )


def series_quality(rows: DataFrame, as_of: Column) -> DataFrame:
    """Null share, staleness, gaps over a week and duplicate rows per series.

    ``rows``: series, date, value. Duplicates are folded to one row per day
    first; only those daily rows are ordered for the gap count.
    """
    daily = rows.groupBy("series", "date").agg(
        F.count("*").alias("_n"), F.count("value").alias("_known")
    )
    gap = F.datediff("date", F.lag("date").over(by_series()))
    return (
        daily.withColumn("_gap", gap)
        .groupBy("series")
        .agg(
            F.sum("_n").alias("row_count"),
            safe_divide(F.sum("_n") - F.sum("_known"), F.sum("_n")).alias("null_rate"),
            F.max("date").alias("last_date"),
            F.count_if(F.col("_gap") > 7).alias("gaps"),
            (F.sum("_n") - F.count("*")).alias("duplicate_rows"),
        )
        .withColumn("days_stale", F.datediff(as_of, F.col("last_date")))
    )


def source_reliability(log: DataFrame) -> DataFrame:
    """Runs, success share and records per source over the state history."""
    ok = F.count_if(F.col("status") == "success")
    return log.groupBy("asset_class", "source").agg(
        F.count("*").alias("runs"),
        safe_divide(ok, F.count("*")).alias("success_rate"),
        F.sum("records").alias("total_records"),
    )


def filled_monthly(dense: DataFrame) -> DataFrame:
    """Monthly trend of a dense panel after forward-fill."""
    return monthly_trend(dense.withColumn("value", ffill("value", by_series())))
