"""Load state: what each source has delivered and which window comes next."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.upsert import upsert_rows
from tideline.schemas import ASSET_CLASSES, DEFAULT_STATE_DATE, LOAD_STATE, STATE_DOCUMENT, conform, inline_rows

STATE_KEYS = ["asset_class", "source"]

# Which asset classes of each source a run plans to load. Silver takes all that have landed.
ROUTES = {
    "yfinance": ASSET_CLASSES,
    "fred": ["economic"],
    "dbnomics": ["economic"],
    "cryptocompare": ["crypto"],
}


def run_plan(spark: SparkSession, selector: str = "all") -> DataFrame:
    """(asset_class, source) pairs to run; ``selector`` is all, a class, a source, or ``yahoo``."""
    wanted = {"yahoo": "yfinance"}.get(selector.lower(), selector.lower())
    rows = [
        (asset_class, source)
        for source, classes in ROUTES.items()
        for asset_class in classes
        if wanted in ("all", source, asset_class)
    ]
    if not rows:
        raise ValueError(f"no source or asset class is called {selector!r}")
    return inline_rows(spark, rows, "asset_class string, source string")


def parse_state_document(documents: DataFrame, column: str = "value") -> DataFrame:
    """Nested state JSON to one row per (asset_class, source)."""
    parsed = documents.select(F.from_json(F.col(column), STATE_DOCUMENT).alias("doc"))
    by_class = parsed.select(F.explode("doc.sources").alias("asset_class", "_sources"))
    flat = by_class.select("asset_class", F.explode("_sources").alias("source", "_entry"))
    return conform(
        flat.select("asset_class", "source", "_entry.*").withColumn(
            "last_update_date", F.try_to_date("last_update_date")
        ),
        LOAD_STATE,
    )


def state_document(state: DataFrame, run_timestamp: str) -> DataFrame:
    """The state rows as one nested JSON document.

    The state holds one row per configured source, a few dozen at most.
    """
    entry = F.struct(
        F.col("last_update_date").cast("string").alias("last_update_date"),
        "status",
        "records_fetched",
        "last_run_timestamp",
    )
    by_class = state.groupBy("asset_class").agg(
        F.map_from_entries(F.collect_list(F.struct("source", entry.alias("entry")))).alias("_sources")
    )
    return by_class.agg(
        F.map_from_entries(F.collect_list(F.struct("asset_class", "_sources"))).alias("sources")
    ).select(
        F.to_json(F.struct(F.lit(run_timestamp).alias("last_run_timestamp"), "sources")).alias("value")
    )


def latest_completed_day(today: Column, trading_days_only: bool) -> Column:
    """Yesterday; with ``trading_days_only`` a weekend falls back to its Friday."""
    yesterday = F.date_sub(today, 1)
    if not trading_days_only:
        return yesterday
    return F.date_sub(yesterday, F.greatest(F.weekday(yesterday) - 4, F.lit(0)))


def load_windows(
    plan: DataFrame,
    state: DataFrame,
    today: dt.date | str,
    trading_days_only: bool = True,
    lookback_days: int = 0,
    target_end: dt.date | str | None = None,
    default_date: str = DEFAULT_STATE_DATE,
) -> DataFrame:
    """Next inclusive [start_date, end_date] per planned source; up-to-date ones are absent.

    ``lookback_days`` re-reads that many earlier days so that values published
    late for an old date are picked up; loads are keyed upserts, so the overlap
    is harmless.
    """
    now = F.lit(str(today)).cast("date")
    latest = latest_completed_day(now, trading_days_only)
    last = F.coalesce(F.col("last_update_date"), F.lit(default_date).cast("date"))
    end = latest if target_end is None else F.least(latest, F.lit(str(target_end)).cast("date"))
    known = state.select(*STATE_KEYS, "last_update_date")
    return (
        plan.join(known, STATE_KEYS, "left")
        .withColumn("last_update_date", last)
        .where(F.date_add("last_update_date", 1) <= end)
        .select(
            *plan.columns,
            "last_update_date",
            F.date_add("last_update_date", 1 - lookback_days).alias("start_date"),
            end.alias("end_date"),
        )
    )


def with_series(plan: DataFrame, column: str = "series") -> DataFrame:
    """Drop planned sources that have nothing to load."""
    return plan.where(F.size(column) > 0)


def advance_state(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """State after a run: success moves the date, failure keeps it and records nothing.

    ``outcomes``: asset_class, source, status, end_date, records, run_timestamp.
    """
    known = state.select(*STATE_KEYS, F.col("last_update_date").alias("_old"))
    done = F.col("status") == "success"
    fresh = outcomes.join(known, STATE_KEYS, "left").select(
        *STATE_KEYS,
        F.when(done, F.col("end_date"))
        .otherwise(F.coalesce("_old", F.lit(DEFAULT_STATE_DATE).cast("date")))
        .alias("last_update_date"),
        "status",
        F.when(done, F.col("records")).otherwise(F.lit(0)).cast("bigint").alias("records_fetched"),
        F.col("run_timestamp").cast("string").alias("last_run_timestamp"),
    )
    return upsert_rows(state, fresh, STATE_KEYS)


def select_groups(groups: DataFrame, selector: str = "all", column: str = "group") -> DataFrame:
    """``groups`` with a boolean ``chosen``: all of them, or the one of that name in any case."""
    named = F.lower(column) == F.lit(selector.lower())
    return groups.withColumn("chosen", F.lit(True) if selector == "all" else F.coalesce(named, F.lit(False)))


def group_outcomes(groups: DataFrame, results: DataFrame, prefix: str = "economic/dbnomics_") -> DataFrame:
    """(source, status, records) of each planned group.

    ``groups``: group, chosen, series_count; ``results``: group, status, records of those that ran.
    Groups that were not chosen, or have no series, are skipped; a chosen one without a result has failed.
    """
    ran = results.select("group", F.col("status").alias("_status"), F.col("records").alias("_records"))
    skipped = ~F.col("chosen") | (F.col("series_count") == 0)
    status = F.when(skipped, "skipped").when(F.col("_status") == "success", "success").otherwise("failed")
    return groups.join(ran, "group", "left").select(
        F.concat(F.lit(prefix), "group").alias("source"), status.alias("status"),
        F.when(status == "success", F.col("_records")).otherwise(F.lit(0)).cast("bigint").alias("records"),
    )


def named_summary(outcomes: DataFrame) -> DataFrame:
    """Sources, their names and records per status. Names are few: one per configured source."""
    return outcomes.groupBy("status").agg(
        F.count("*").alias("sources"), F.array_join(F.sort_array(F.collect_list("source")), ", ").alias("names"),
        F.sum("records").alias("total_records"),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Sources and records per outcome status."""
    return outcomes.groupBy("status").agg(
        F.count("*").alias("sources"), F.sum("records").alias("total_records")
    )
