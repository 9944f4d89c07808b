"""One registered query per operator group, over the whole driver tables.

Where an operator needs dirty or missing input, faults are written into rows by
their key; no rows are left out of any table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalar import is_valid_ticker, parse_number, parse_period
from tideline.operators import cleanse, metrics, panel, quality, resolve, scan, sketches, state, universe, upsert
from tideline.plans import carry
from tideline.plans import gold as gold_plan
from tideline.plans.silver import run_silver
from tideline.schemas import (
    BASE_COLUMNS,
    BRONZE_PRICES,
    COIN_MARKET,
    SILVER_CRYPTO,
    SILVER_MACRO,
    SILVER_PRICES,
    conform,
    gold_schema,
    inline_rows,
)
from tideline.session import materialize, scratch_path
from tideline.sinks import files
from tideline.sinks import lake as sink
from tideline.sinks.warehouse import reconcile, rows_to_append
from tideline.sources import census, lake, landing, marks
from tideline.sources import universe as documents
from tideline.streaming import ingest, late
from tideline.workload.standins import (
    event_bars,
    macro_rows,
    order_panel,
    ship_panel,
    status_panel,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round rolled statistics, whose last bits depend on summation order; no negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def stamp() -> Column:
    """Fixed audit time, so that reruns give equal rows."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


# -- cleaning ----------------------------------------------------------------


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per event with the faults that landed bars have."""
    n, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("date"),
        (v / 3.0).alias("open"),
        F.when(n % 83 == 0, v / 4.0).when(n % 79 == 0, F.lit(None)).otherwise(v).alias("high"),
        (v / 3.5).alias("low"),
        F.when(n % 97 == 0, F.lit(None))
        .when(n % 89 == 0, F.lit(0.0))
        .when(n % 73 == 0, F.lit(float("nan")))
        .otherwise(v / 3.1)
        .alias("close"),
        (v / 3.3).alias("adj_close"),
        (F.col("user_id") * 10).alias("volume"),
        F.col("event_type").alias("ticker"),
        F.lit("2024-02-01T00:00:00").alias("fetch_timestamp"),
    )


@register
def silver_quality_filter(spark, sf_dir):
    silver = cleanse.silver_prices(raw_bars(spark, sf_dir), "crypto", "daily", None, stamp())
    return silver.drop("transform_timestamp")


@register
def macro_conform(spark, sf_dir):
    rows = macro_rows(spark, sf_dir).select(
        F.col("series").alias("series_id"),
        "date",
        F.when(F.month("date") == 6, F.lit(None))
        .when(F.month("date") == 9, F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("value"),
    )
    silver = cleanse.silver_macro(rows, "economic", "fred", "historical", transform_timestamp=stamp())
    return silver.drop("transform_timestamp")


@register
def crypto_conform(spark, sf_dir):
    rows = event_bars(spark, sf_dir).select(
        "date", F.col("series").alias("symbol"), "open", "high", "low", "close",
        F.col("volume").cast("double").alias("volume_from"),
        (F.col("volume") * F.col("close")).alias("volume_to"),
    )
    silver = cleanse.silver_crypto(rows, "crypto", "historical", transform_timestamp=stamp())
    return silver.drop("transform_timestamp")


@register
def history_floor(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice"
    )
    return cleanse.history_floor(orders, "1998-01-01")


@register
def date_range_clip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice"
    )
    return cleanse.clip_dates(orders, "1997-03-01", "1997-09-30")


@register
def ohlc_all_null_drop(spark, sf_dir):
    n, v = F.col("event_id"), F.col("value")

    def gap(every: int) -> Column:
        return F.when(n % every != 0, v)

    bars = table(spark, sf_dir, "events").select(
        "event_id", gap(2).alias("open"), gap(3).alias("high"), gap(5).alias("low"), gap(7).alias("close")
    )
    return cleanse.drop_empty_bars(bars)


@register
def coerce_dates_numbers(spark, sf_dir):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    text_date = (
        F.when(k % 6 == 0, F.date_format(d, "yyyy"))
        .when(k % 6 == 1, F.date_format(d, "yyyy-MM"))
        .when(k % 6 == 2, F.concat_ws("-", F.year(d), F.concat(F.lit("Q"), F.quarter(d))))
        .when(k % 6 == 3, F.lit("bad"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    text_number = (
        F.when(k % 5 == 0, F.lit("n/a"))
        .when(k % 5 == 1, F.lit("NaN"))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    )
    landed = table(spark, sf_dir, "orders").select(
        "o_orderkey", text_date.alias("period"), text_number.alias("raw")
    )
    return landed.select(
        "o_orderkey", parse_period("period").alias("date"), parse_number("raw").alias("value")
    ).dropna(subset=["date", "value"])


@register
def csv_numeric_cleanse(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    dirty = (
        F.when(k % 7 == 0, F.lit("NA"))
        .when(k % 7 == 1, F.lit(" . "))
        .when(k % 7 == 2, F.lit("  "))
        .when(k % 7 == 3, F.format_number(p, 2))
        .when(k % 7 == 4, F.lit("x1"))
        .otherwise(p.cast("decimal(18,2)").cast("string"))
    )
    text = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("DATE"),
        k.cast("string").alias("Order_Key"),
        dirty.alias("Price"),
        F.lit("12").alias("Jobless_Claims"),
    )
    return cleanse.cleanse_csv(text, null_columns=["jobless_claims"])


@register
def weekday_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("date"))
    return quality.weekend_report(events, "event_type")


# -- landed payloads -----------------------------------------------------------


def macro_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per flag and year, so at most twelve observations each."""
    monthly = table(spark, sf_dir, "lineitem").groupBy(
        "l_returnflag", F.trunc(F.to_date("l_shipdate"), "month").alias("m")
    ).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    month = F.month("m")
    period = (
        F.when(month % 3 == 1, F.concat_ws("-", F.year("m"), F.concat(F.lit("Q"), F.quarter("m"))))
        .when(month == 6, F.lit("n/a"))
        .when(month == 8, F.date_format("m", "yyyy-MM-dd"))
        .otherwise(F.date_format("m", "yyyy-MM"))
    )
    value = F.when(month == 9, F.lit("NA")).otherwise(F.col("q").cast("string"))
    year = F.year("m")
    docs = monthly.select("l_returnflag", year.alias("y"), period.alias("p"), value.alias("v")).groupBy(
        "l_returnflag", "y"
    ).agg(F.collect_list(F.struct("p", "v")).alias("obs"))
    flag = F.col("l_returnflag")
    document = F.struct(F.struct(F.array(F.struct(
        F.col("obs.p").alias("period"),
        F.col("obs.v").alias("value"),
        F.concat(F.lit("Flag "), flag).alias("series_name"),
        F.lit("pieces").alias("unit"),
        F.when(flag == "A", F.lit("units")).alias("@unit"),
        F.lit("monthly").alias("frequency"),
    )).alias("docs")).alias("series"))
    return docs.select(
        F.when(flag == "N", F.lit("PRV/DSN"))
        .otherwise(F.concat(F.lit("PRV/DS"), flag, F.lit("/Q."), F.col("y"), F.lit("/X")))
        .alias("series_id"),
        F.to_json(document).alias("payload"),
    )


@register
def json_payload_rows(spark, sf_dir):
    rows = landing.macro_payload_rows(
        macro_documents(spark, sf_dir), start="1995-06-01", end="2001-06-30", fetch_timestamp=stamp()
    )
    return rows.drop("fetch_timestamp")


@register
def crypto_payload_rows(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    bar = F.struct(
        (F.unix_date("date").cast("bigint") * 86400).alias("time"),
        "open", "high", "low", "close",
        F.col("volume").cast("double").alias("volumefrom"),
        (F.col("volume") * F.lit(2.0)).alias("volumeto"),
    )
    docs = bars.groupBy("series", F.trunc("date", "month").alias("m")).agg(
        F.collect_list(bar).alias("bars")
    )
    payload = F.struct(
        F.when(F.col("series") == "error", F.lit("Error")).otherwise(F.lit("Success")).alias("Response"),
        F.struct(F.col("bars").alias("Data")).alias("Data"),
    )
    landed = docs.select(
        F.concat(F.upper("series"), F.lit("-USD")).alias("ticker"), F.to_json(payload).alias("payload")
    )
    rows = landing.crypto_payload_rows(landed, start="2024-01-05", end="2024-01-25", fetch_timestamp=stamp())
    return rows.drop("fetch_timestamp")


@register
def macro_observations(spark, sf_dir):
    k = F.col("o_orderkey")
    landed = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(k % 4 == 0, F.lit(".")).otherwise(k.cast("string")).alias("value"),
    )
    return landing.observation_rows(landed, stamp()).drop("fetch_timestamp")


@register
def event_property_parse(spark, sf_dir):
    props = F.from_json("props", "struct<k: int>")
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.sum(props["k"]).alias("k_sum"), F.count(props["k"]).alias("k_count"))
    )


@register
def paged_backfill_merge(spark, sf_dir):
    """Backfill pages overlap by a year; each order must come out once."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice"
    )
    pages = [  # a later page revises what the one before it says of the overlap
        cleanse.clip_dates(orders, start=start, end=end).withColumns({
            "o_totalprice": F.col("o_totalprice") + page, "fetched": F.lit(page)
        })
        for page, (start, end) in enumerate([(None, "1997-12-31"), ("1997-01-01", "2000-06-30"), ("2000-01-01", None)])
    ]
    return resolve.merge_pages(pages[::-1], ["o_orderkey", "date"], ["fetched"]).drop("fetched")


@register
def asset_list_ids(spark, sf_dir):
    """Identifiers listed in JSON documents, one document per order."""
    docs = table(spark, sf_dir, "orders").select(
        F.to_json(F.struct(F.array(
            F.struct(F.concat(F.lit("C-"), F.col("o_custkey")).alias("yahoo_finance")),
            F.struct(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("yahoo_finance")),
        ).alias("assets"))).alias("value")
    )
    return documents.listed_ids(docs, "assets", "yahoo_finance")


@register
def unpivot_grid(spark, sf_dir):
    ids = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = panel.pivot_wide(order_panel(spark, sf_dir), ids)
    return panel.unpivot_grid(cleanse.snake_names(wide), ["date"], [i.lower().replace(" ", "_") for i in ids])


@register
def grid_bars(spark, sf_dir):
    """Landed grid with one column per (ticker, field) back to one bar per row."""
    tickers, fields = sorted(EVENT_CLASSES), ["open", "high", "low", "close", "volume"]
    bars = event_bars(spark, sf_dir)
    grid = bars.groupBy("date").agg(*[
        F.max(F.when((F.col("series") == t), F.col(f))).alias(f"{t}|{f}") for t in tickers for f in fields
    ])
    return panel.grid_to_bars(grid, tickers, fields)


@register
def landed_mixed_files(spark, sf_dir):
    """One folder, two writers: integer nanoseconds, NaN volumes and a column more in half of the files."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("date"),
        F.col("o_orderpriority").alias("ticker"), F.col("o_totalprice").alias("close"),
        F.col("o_orderkey").cast("bigint").alias("volume"),
    )
    root = scratch_path(spark, "landed")
    rows.where("key % 2 = 0").drop("key").write.mode("append").parquet(f"{root}/files")
    rows.where("key % 2 = 1").withColumns({
        "date": F.unix_micros(F.col("date").cast("timestamp")) * 1000,
        "volume": F.when(F.col("key") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("volume").cast("double")),
        "adj_close": F.col("close"),
    }).drop("key").write.mode("append").parquet(f"{root}/files")
    landed = lake.scan_prefix(spark, root, f"{root}/files", BRONZE_PRICES, landed=True)
    return landed.select(F.to_date("date").alias("date"), "ticker", "close", "adj_close", "volume")


def _order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as landed bars; a tenth has no close, another one crossed extremes."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("key"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("date"), F.col("o_orderpriority").alias("ticker"),
        F.when(k % 10 != 3, F.col("o_totalprice")).alias("close"), (F.col("o_totalprice") + 1).alias("high"),
        F.when(k % 10 == 4, F.col("o_totalprice") + 2).otherwise(F.col("o_totalprice")).alias("low"), k.alias("volume"),
    )


def _land_many_files(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Four writers that disagree on types and columns, some dozens of small files each."""
    bars = _order_bars(spark, sf_dir)
    nanos = F.unix_micros(F.col("date").cast("timestamp")) * 1000
    writers = [
        {}, {"date": nanos}, {"date": nanos, "volume": F.col("volume").cast("double"), "adj_close": F.col("close")},
        {"volume": F.col("volume").cast("string"), "adj_close": F.col("close").cast("float")},
    ]
    for k, columns in enumerate(writers):
        rows = bars.where(F.col("key") % 4 == k).withColumns(columns).drop("key")
        rows.repartition(40).write.mode("append").parquet(f"{root}/files")


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """A file with these bytes on any file system of Spark's."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target)
    out.write(content, 0, len(content))
    out.close()


@register
def landed_many_files(spark, sf_dir):
    """A folder of small files with four physical schemas: one census, a scan per group of types."""
    root = scratch_path(spark, "landed")
    _land_many_files(spark, sf_dir, root)
    landed = lake.scan_prefix(spark, root, f"{root}/files", BRONZE_PRICES, landed=True)
    return landed.select(F.to_date("date").alias("date"), "ticker", "close", "volume", F.col("adj_close").isNotNull().alias("adjusted"))


@register
def landed_skips(spark, sf_dir):
    """Files found, read and skipped, then rows removed by each cleaning stage, of one tolerant pass."""
    root = scratch_path(spark, "landed")
    _land_many_files(spark, sf_dir, root)
    for k, content in enumerate([b"", b"PAR1", b"not a file of columns" * 99]):
        _put(spark, f"{root}/files/damaged-{k}.parquet", content)
    found = census.file_census(spark, f"{root}/files")
    landed = lake.scan_prefix(
        spark, root, f"{root}/files", BRONZE_PRICES, tolerate_corrupt=True, landed=True, census=found, file_column="source_file"
    )
    copy = materialize(landed, "landed")
    totals = census.account_totals(census.file_accounts(found, copy))
    kept, seen = quality.staged(copy, [
        ("history_floor", lambda df: cleanse.history_floor(df, "1995-01-01")),
        ("priced", lambda df: df.where("close IS NOT NULL")), ("valid_bars", cleanse.valid_bars),
    ])
    materialize(kept, "kept")
    stages = quality.stage_report(spark, seen)
    files = totals.select(
        F.lit(0).alias("position"), F.lit("files").alias("stage"), F.col("files_found").alias("rows_read"),
        F.col("files_read").alias("rows_kept"), F.col("files_skipped").alias("rows_removed"),
    )
    return files.unionByName(stages)


@register
def crypto_landed_values(spark, sf_dir):
    """Exchange bars whose ticker is known only as symbol, or whose date only from the load's day."""
    bronze = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("ticker"),
        F.col("o_orderstatus").alias("symbol"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("date"),
        F.col("o_orderkey").cast("double").alias("close"),
    )
    silver = cleanse.silver_crypto(bronze, "crypto", "daily", "2024-01-05")
    return silver.select(F.col("close").cast("bigint").alias("o_orderkey"), "ticker", "date")


# -- picking, mapping, aligning ------------------------------------------------


@register
def dedup_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("date"), "event_type", "value", "ts", "event_id"
    )
    return resolve.keep_last(rows, ["user_id", "date"], ["ts", "event_id"]).drop("ts")


@register
def source_priority_pick(spark, sf_dir):
    both = resolve.union_all([
        ship_panel(spark, sf_dir).withColumns({"source": F.lit("lines"), "priority": F.lit(2)}),
        status_panel(spark, sf_dir).withColumns({"source": F.lit("orders"), "priority": F.lit(1)}),
    ])
    return resolve.keep_preferred(both, ["series", "date"], "priority", ["value"])


PRIORITY_MAP = {"1-URGENT": "sp500", "2-HIGH": "nasdaq", "3-MEDIUM": "gold", "5-LOW": "oil"}
ALL_PRIORITIES = {**PRIORITY_MAP, "4-NOT SPECIFIED": "silver"}


@register
def map_series(spark, sf_dir):
    dim = inline_rows(spark, list(PRIORITY_MAP.items()), "series_id string, column_name string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return panel.map_series(orders, dim, "o_orderpriority", list(PRIORITY_MAP))


@register
def pivot_wide(spark, sf_dir):
    rows = order_panel(spark, sf_dir).replace(ALL_PRIORITIES, subset=["series"])
    return panel.pivot_wide(rows, list(ALL_PRIORITIES.values()))


@register
def outer_merge_by_date(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.max("o_totalprice").alias("value")
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.max("l_extendedprice").alias("value")
    )
    events = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(
        F.max("value").alias("value")
    )
    named = [
        df.withColumn("series", F.lit(name))
        for name, df in (("orders", orders), ("lines", lines), ("events", events))
    ]
    return panel.outer_merge(named, ["orders", "lines", "events"])


def dense_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.densify(panel.keep_weekdays(order_panel(spark, sf_dir)))


@register
def densify_calendar(spark, sf_dir):
    return dense_orders(spark, sf_dir)


def macro_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series next to their rounded-down, mostly constant version."""
    rows = macro_rows(spark, sf_dir)
    variants = F.array(
        F.struct(F.col("series").alias("series"), F.col("value").alias("value")),
        F.struct(
            F.concat(F.lit("held_"), F.col("series")).alias("series"),
            F.floor(F.col("value") / 10).cast("double").alias("value"),
        ),
    )
    return rows.select("date", F.inline(variants)).select("series", "date", "value")


def filled_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = panel.keep_weekdays(order_panel(spark, sf_dir)).select("date")
    observed = macro_panel(spark, sf_dir)
    days = calendar.union(panel.keep_weekdays(observed).select("date")).distinct()
    dense = panel.densify(panel.keep_weekdays(observed), calendar=days)
    return panel.fill_forward(dense)


@register
def forward_fill(spark, sf_dir):
    return filled_macro(spark, sf_dir)


# -- series metrics --------------------------------------------------------------


@register
def event_return_vol7(spark, sf_dir):
    """Flagship: ticks to daily bars to weekday returns to rolling volatility."""
    bars = event_bars(spark, sf_dir).select("series", "date", F.col("close").alias("value"))
    dense = panel.densify(panel.keep_weekdays(bars))
    vol = dense.transform(metrics.add_returns).transform(metrics.add_volatility)
    out = vol.select("series", "date", F.col("value").alias("close"), "ret", "vol_7d", "vol_7d_annualized")
    return rounded(out, 4, "vol_7d", "vol_7d_annualized")


@register
def daily_return_pad(spark, sf_dir):
    return metrics.add_returns(dense_orders(spark, sf_dir))


@register
def daily_return_nofill(spark, sf_dir):
    return metrics.add_returns(dense_orders(spark, sf_dir), "none")


@register
def rolling_vol_7(spark, sf_dir):
    out = metrics.add_volatility(metrics.add_returns(dense_orders(spark, sf_dir)))
    return rounded(out.select("series", "date", "vol_7d", "vol_7d_annualized"), 4, "vol_7d", "vol_7d_annualized")


@register
def rolling_vol_30_ann(spark, sf_dir):
    out = metrics.add_volatility(metrics.add_returns(dense_orders(spark, sf_dir)))
    return rounded(out.select("series", "date", "vol_30d"), 4, "vol_30d")


@register
def rolling_corr_90(spark, sf_dir):
    pairs = inline_rows(
        spark,
        [("urgent_high", "1-URGENT", "2-HIGH"), ("medium_low", "3-MEDIUM", "5-LOW")],
        "pair string, left_series string, right_series string",
    )
    returns = metrics.add_returns(dense_orders(spark, sf_dir))
    return rounded(metrics.pair_correlation(returns, pairs), 6, "corr")


@register
def rolling_zscore_252(spark, sf_dir):
    out = metrics.add_zscore(filled_macro(spark, sf_dir)).select("series", "date", "z")
    return rounded(out, 6, "z")


@register
def normalized_price(spark, sf_dir):
    return metrics.add_norm(dense_orders(spark, sf_dir)).select("series", "date", "norm")


@register
def source_price_gap(spark, sf_dir):
    both = resolve.union_all([
        rows.groupBy(F.lit(name).alias("series"), "date").agg(F.max("value").alias("value"))
        for name, rows in (("orders", status_panel(spark, sf_dir)), ("lines", ship_panel(spark, sf_dir)))
    ])
    return panel.price_gap(both, "orders", "lines")


# -- the wide table ----------------------------------------------------------------

GOLD_TICKERS = {
    "1-URGENT": "BTC-USD", "2-HIGH": "^GSPC", "3-MEDIUM": "ETH-USD", "4-NOT SPECIFIED": "GC=F",
    "5-LOW": "CL=F",
}
GOLD_FLOOR = "1996-01-01"


def _label(column: str, mapping: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in mapping.items():
        out = F.when(F.col(column) == key, F.lit(value)).otherwise(out)
    return out


def silver_standins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders and line items as silver rows: versions, two sources per column, unmapped series."""
    prices = conform(table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"),
        _label("o_orderpriority", GOLD_TICKERS).alias("ticker"),
        F.col("o_totalprice").alias("close"),
        F.timestamp_micros("o_orderkey").alias("transform_timestamp"),
    ), SILVER_PRICES)
    crypto = conform(table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        _label("l_linestatus", {"F": "BTC-USD", "O": "ETH-USD"}).alias("ticker"),
        F.col("l_extendedprice").alias("close"),
        F.timestamp_micros("l_orderkey").alias("transform_timestamp"),
    ), SILVER_CRYPTO)
    monthly = macro_rows(spark, sf_dir)
    feeds = {
        ("fred", "R"): "DFF", ("fred", "A"): "DGS10", ("fred", "N"): "CSCICP02JPM460S",
        ("dbnomics", "R"): "OECD/MEI_CLI/LOLITOAA.JPN.M", ("dbnomics", "A"): "UNMAPPED/X/Y",
        ("dbnomics", "N"): "BIS/WS_CBPOL/D.XM",
    }
    variants = F.array(*[
        F.struct(
            F.lit(source).alias("data_source"),
            F.when(F.col("series") == flag, F.lit(code)).alias("indicator"),
        )
        for (source, flag), code in feeds.items()
    ])
    macro = monthly.select("date", "value", F.inline(variants)).where("indicator IS NOT NULL")
    # the preferred source of cc_jp has values in even months only
    unknown = (F.col("indicator") == "CSCICP02JPM460S") & (F.month("date") % 2 == 1)
    macro = macro.withColumn("value", F.when(~unknown, F.col("value")))
    macro = conform(macro, SILVER_MACRO).withColumn("data_source", F.when(
        F.col("indicator").contains("/"), F.lit("dbnomics")).otherwise(F.lit("fred")))
    return prices, crypto, macro


def _gold_view(df: DataFrame) -> DataFrame:
    vols = [c for c in df.columns if "_vol_" in c]
    scores = [c for c in df.columns if c.endswith("_z") or c.startswith("corr_")]
    return rounded(rounded(df, 4, *vols), 6, *scores)


@register
def gold_wide_metrics(spark, sf_dir):
    rows = gold_plan.curated_panel(*silver_standins(spark, sf_dir), floor=GOLD_FLOOR)
    return _gold_view(gold_plan.build_gold(rows))


def _arrivals(rows: DataFrame) -> DataFrame:
    """The batch that each observation lands in: history, a later part of it, a batch of late values.

    Late are a preferred source, the weekends of one year, and one priced series in one month.
    """
    late = (
        ((F.col("series") == "cc_jp") & (F.col("priority") == 1) & (F.year("date") == 2000))
        | ((F.dayofweek("date").isin(1, 7)) & (F.year("date") == 1999))
        | ((F.col("series") == "bitcoin_price") & (F.month("date") == 6) & (F.year("date") == 2000))
    )
    return rows.withColumn("batch", F.when(late, 2).when(F.col("date") >= "2001-03-01", 1).otherwise(0))


def _appended(spark: SparkSession, sf_dir: str, options: gold_plan.GoldOptions) -> DataFrame:
    rows = gold_plan.curated_rows(*silver_standins(spark, sf_dir), floor=GOLD_FLOOR)
    landed = materialize(_arrivals(rows), "landed")
    store = carry.Store(scratch_path(spark, "gold"), gold_schema())
    steps = [landed.where(F.col("batch") == k).drop("batch") for k in (0, 1, 2)]
    build = lambda rows: gold_plan.build_gold(rows, options)
    carry.rebuild(spark, store, steps[0], build)
    for step in steps[1:]:
        out = carry.append(spark, store, step, build)
    return _gold_view(out)


@register
def gold_append(spark, sf_dir):
    """Later months, then late values of earlier ones, appended: equal to one full refresh."""
    return _appended(spark, sf_dir, gold_plan.GoldOptions())


@register
def gold_append_filled_first(spark, sf_dir):
    """As gold_append, with weekend values of slow series carried into the week, also over the start of a tail."""
    return _appended(spark, sf_dir, gold_plan.GoldOptions(fill_first=True))


@register
def published_base_columns(spark, sf_dir):
    """Published as Parquet and CSV; the CSV read back, cleansed, base columns only."""
    rows = gold_plan.curated_panel(*silver_standins(spark, sf_dir), floor=GOLD_FLOOR)
    root = scratch_path(spark, "lake")
    sink.write_published(gold_plan.build_gold(rows), root)
    text = lake.scan_published_csv(spark, root, " /curated/macro_market_merged.csv. ")
    return lake.base_columns_only(reconcile(cleanse.cleanse_csv(text)))


# -- endless series --------------------------------------------------------------------


@register
def endless_series(spark, sf_dir):
    """Fill, base 100 and drawdown per tick, without folding to days; one series has most of the rows."""
    events = table(spark, sf_dir, "events")
    ticks = events.select(
        F.when(F.col("event_id") % 10 < 7, F.lit("busy")).otherwise(F.col("event_type")).alias("series"), "ts", "event_id",
        F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"),
    )
    return scan.running_metrics(ticks, order=["ts", "event_id"]).drop("ts")


# -- upserts and marks -----------------------------------------------------------------


def _daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.max("o_totalprice").alias("high"), F.count("*").alias("orders")
    )


@register
def upsert_by_date(spark, sf_dir):
    daily = _daily_orders(spark, sf_dir)
    old = cleanse.clip_dates(daily, end="2001-01-31")
    new = cleanse.clip_dates(daily, start="2001-01-01").select("date", (F.col("orders") * 10).alias("orders"))
    return upsert.upsert_rows(old, new)


@register
def upsert_touched_months(spark, sf_dir):
    """A revised quarter upserted into a table by month; other months are neither read nor rewritten."""
    daily = _daily_orders(spark, sf_dir).withColumn("month", F.trunc("date", "month"))
    path = scratch_path(spark, "by_month")
    batch = cleanse.clip_dates(daily, "1996-01-01", "1996-03-31").where(F.dayofmonth("date") != 5)
    batch = batch.withColumn("orders", F.col("orders") * 10)
    for rows in (daily, batch, batch):
        files.upsert_partitions(spark, path, daily.schema, rows, ["date"], "month")
    return spark.read.schema(daily.schema).parquet(path).drop("month")


@register
def compacted_bars(spark, sf_dir):
    """Small files by year compacted to a size in bytes and clustered; rows, and whether the files are as planned."""
    bars = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("date"), "l_quantity"
    )
    path, target = scratch_path(spark, "bars"), 200_000
    bars.repartition(12).write.partitionBy("year").parquet(path)
    files.compact_folders(spark, path, bars.schema, ["year"], ["part", "date"], target)
    plan = files.folder_plan(spark, path, target).select(
        F.regexp_extract("folder", "year=([0-9]+)$", 1).cast("int").alias("year"), (F.col("files") <= F.col("planned") + 1).alias("as_planned")
    )
    counted = spark.read.schema(bars.schema).parquet(path).groupBy("year").agg(
        F.count("*").alias("bars"), F.sum("l_quantity").alias("quantity"), F.count_distinct("part").alias("parts")
    )
    return counted.join(plan, "year")


@register
def upsert_cells_by_date(spark, sf_dir):
    daily = _daily_orders(spark, sf_dir)
    old = cleanse.clip_dates(daily, end="2001-01-31")
    new = cleanse.clip_dates(daily, start="2001-01-01").select(
        "date", F.lit(None).cast("double").alias("high"), (F.col("orders") * 10).alias("orders")
    )
    return upsert.upsert_cells(old, new)


@register
def append_newer_than_max(spark, sf_dir):
    daily = _daily_orders(spark, sf_dir)
    return upsert.newer_than(daily, cleanse.clip_dates(daily, end="2000-12-31"))


@register
def high_water_mark(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return upsert.high_water_mark(orders)


@register
def warehouse_append(spark, sf_dir):
    """Rows a daily load would add to the 96-column warehouse table."""
    rows = _daily_orders(spark, sf_dir).select(
        F.col("date").alias("DATE"), F.col("high").alias("SP500"), F.col("orders").alias("extra")
    )
    loaded = rows.select(F.col("DATE").alias("date")).where("date <= DATE'2000-12-31'")
    return rows_to_append(rows, loaded)


@register
def warehouse_columns(spark, sf_dir):
    """Reconciled column set, filled cells counted per warehouse column."""
    rows = _daily_orders(spark, sf_dir).select("date", F.col("high").alias("GOLD"), "orders")
    fixed = reconcile(rows)
    names = [f.name for f in gold_schema().fields]
    counts = fixed.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "filled")


# -- universes ---------------------------------------------------------------------------

# Symbol endings that exercise the validity rules.
SYMBOL_ENDINGS = ["", "", "", "", ".A", "-WS", "-P", "-PA", "+", "1", "LMN", "-U"]


def _symbol(key: Column) -> Column:
    letters = [F.char(F.lit(65) + F.floor(key / 26**i).cast("bigint") % 26) for i in range(3)]
    ending = F.element_at(F.array(*map(F.lit, SYMBOL_ENDINGS)), (key % 12 + 1).cast("int"))
    return F.concat(*letters, ending)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listed symbols; large parts are listed on a second exchange too."""
    names = F.array(F.lit("nasdaq"), F.lit("nyse"), F.lit("amex"))
    k = F.col("p_partkey")
    first = F.element_at(names, (k % 3 + 1).cast("int"))
    second = F.element_at(names, ((k + 1) % 3 + 1).cast("int"))
    where = F.when(F.col("p_size") > 40, F.array(first, second)).otherwise(F.array(first))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), _symbol(k), F.lit(" ")).alias("symbol"),
        F.concat(F.col("p_name"), F.lit(" ")).alias("name"),
        F.explode(where).alias("exchange"),
    )


def weekly_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly close and volume per symbol: line items fold by part before the symbol is joined."""
    by_part = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("p_partkey"),
        F.date_trunc("week", F.to_date("l_shipdate")).cast("date").alias("date"),
    ).agg(F.max("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"))
    tickers = table(spark, sf_dir, "part").select("p_partkey", _symbol(F.col("p_partkey")).alias("symbol"))
    return by_part.join(tickers, "p_partkey").groupBy("symbol", "date").agg(
        (F.max("price") * 100).alias("close"), F.sum("quantity").alias("volume")
    )


def stock_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = universe.listed_symbols(listings(spark, sf_dir))
    volumes = universe.dollar_volumes(universe.last_quotes(weekly_quotes(spark, sf_dir)))
    return universe.liquid_universe(symbols, volumes)


@register
def ticker_validity(spark, sf_dir):
    """Every word of every document, as a candidate symbol."""
    words = table(spark, sf_dir, "documents").select(
        F.explode(F.split("text", r"[ \n]+")).alias("symbol")
    )
    counted = words.groupBy("symbol").agg(F.count("*").alias("uses"))
    valid = counted.withColumn("valid", is_valid_ticker("symbol") & (F.col("symbol") != ""))
    return valid.groupBy("valid", F.length("symbol").alias("length")).agg(
        F.count("*").alias("symbols"), F.sum("uses").alias("uses")
    )


@register
def exchange_symbols(spark, sf_dir):
    return universe.listed_symbols(listings(spark, sf_dir))


@register
def universe_dollar_volume(spark, sf_dir):
    return stock_universe(spark, sf_dir)


@register
def universe_by_exchange(spark, sf_dir):
    return universe.count_by_exchange(stock_universe(spark, sf_dir))


@register
def universe_tiers(spark, sf_dir):
    return universe.count_by_tier(stock_universe(spark, sf_dir))


@register
def universe_top10(spark, sf_dir):
    return universe.top_symbols(stock_universe(spark, sf_dir), 10)


@register
def universe_header(spark, sf_dir):
    head = universe.universe_header(stock_universe(spark, sf_dir), 1_000_000, "2024-01-31T00:00:00Z")
    return head.withColumn("exchanges", F.array_join("exchanges", ","))


@register
def universe_published(spark, sf_dir):
    """The universe written as JSON lines and read back."""
    stocks = materialize(stock_universe(spark, sf_dir), "universe")
    path = scratch_path(spark, "universe")
    sink.write_universe(stocks, universe.universe_header(stocks, 1_000_000, "2024-01-31T00:00:00Z"), path)
    return spark.read.schema(stocks.schema).json(f"{path}/rows")


# Coin symbols, some of them excluded ones.
COIN_SYMBOLS = ["btc", "usdt", "eth", "weth", "sol", "dai", "ada", "xrp"]


def coin_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("coin-"), k).alias("id"),
        F.element_at(F.array(*map(F.lit, COIN_SYMBOLS)), (k % 8 + 1).cast("int")).alias("symbol"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") * 50).alias("market_cap"),
        F.col("c_nationkey").alias("market_cap_rank"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") * 400).alias("total_volume"),
        F.col("c_acctbal").alias("current_price"),
        F.lit("2024-01-31").alias("last_updated"),
    )
    return conform(rows, COIN_MARKET)


@register
def coin_universe(spark, sf_dir):
    return universe.coin_universe(coin_markets(spark, sf_dir))


@register
def coin_top20(spark, sf_dir):
    return universe.top_coins(universe.coin_universe(coin_markets(spark, sf_dir)), 20)


# -- load state --------------------------------------------------------------------------


def load_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event type, source and day; a run with an outlier counts as failed."""
    source = F.concat(F.lit("src_"), F.col("user_id") % 5)
    return table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("asset_class"), source.alias("source"),
        F.to_date("ts").alias("end_date"),
    ).agg(
        F.count("*").alias("records"),
        F.when(F.max("value") > 200, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
    ).withColumn("run_timestamp", F.concat(F.col("end_date").cast("string"), F.lit("T03:00:00")))


def known_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every class but one: the last successful day before the final week."""
    done = load_log(spark, sf_dir).where(
        "status = 'success' AND end_date <= DATE'2024-01-24' AND asset_class <> 'error'"
    )
    return done.groupBy("asset_class", "source").agg(
        F.max("end_date").alias("last_update_date"),
        F.lit("success").alias("status"),
        F.max_by("records", "end_date").alias("records_fetched"),
        F.max("run_timestamp").alias("last_run_timestamp"),
    )


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_log(spark, sf_dir).select("asset_class", "source").distinct()


@register
def load_windows(spark, sf_dir):
    return state.load_windows(
        planned(spark, sf_dir), known_state(spark, sf_dir), "2024-01-29",
        trading_days_only=True, default_date="2023-12-31",
    )


@register
def load_windows_lookback(spark, sf_dir):
    return state.load_windows(
        planned(spark, sf_dir), known_state(spark, sf_dir), "2024-01-29", trading_days_only=False,
        lookback_days=7, target_end="2024-01-27", default_date="2023-12-31",
    )


@register
def state_upsert(spark, sf_dir):
    log = load_log(spark, sf_dir)
    last = resolve.keep_last(log, ["asset_class", "source"], ["end_date"])
    return state.advance_state(known_state(spark, sf_dir), last)


@register
def state_document_roundtrip(spark, sf_dir):
    doc = state.state_document(known_state(spark, sf_dir), "2024-01-25T00:00:00")
    return state.parse_state_document(doc)


@register
def run_summary(spark, sf_dir):
    return state.run_summary(load_log(spark, sf_dir))


@register
def run_plan_with_series(spark, sf_dir):
    """Users whose large events name at least one series to load."""
    plan = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_set(F.when(F.col("value") > 100, F.col("event_type"))).alias("series")
    )
    return state.with_series(plan).select("user_id", F.size("series").cast("bigint").alias("series_count"))


@register
def source_reliability(spark, sf_dir):
    return quality.source_reliability(load_log(spark, sf_dir))


# -- reports -----------------------------------------------------------------------------


@register
def run_report(spark, sf_dir):
    return quality.span_report(order_panel(spark, sf_dir))


@register
def series_listing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return quality.series_listing(orders, "o_orderpriority", "o_orderstatus")


@register
def records_per_date(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return quality.records_per_date(orders)


@register
def preview_latest(spark, sf_dir):
    return order_panel(spark, sf_dir).orderBy(F.col("date").desc(), "series").limit(5)


@register
def max_drawdown(spark, sf_dir):
    return quality.max_drawdown(order_panel(spark, sf_dir))


@register
def performance_rank(spark, sf_dir):
    """Every customer's order value as a series."""
    rows = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("series"), F.to_date("o_orderdate").alias("date")
    ).agg(F.max("o_totalprice").alias("value"))
    return quality.performance(rows, "1996-01-01", "2000-12-31")


@register
def corr_matrix(spark, sf_dir):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    returns = metrics.add_returns(dense_orders(spark, sf_dir))
    wide = panel.pivot_wide(returns, names, value="ret")
    return rounded(quality.correlation_matrix(wide, names), 6, "corr")


@register
def shock_days(spark, sf_dir):
    vol = metrics.add_volatility(metrics.add_returns(dense_orders(spark, sf_dir)))
    return quality.shock_days(vol).select("series", "date", "value", "ret")


@register
def macro_yoy(spark, sf_dir):
    return quality.filled_monthly(filled_macro(spark, sf_dir))


@register
def series_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("series"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"),
    )
    return quality.series_quality(rows, F.lit("2001-12-31").cast("date"))


# -- lake and stream ---------------------------------------------------------------------

EVENT_CLASSES = {
    "view": "stocks", "signup": "indices", "error": "bonds", "click": "crypto",
    "purchase": "commodities",
}


@register
def lake_silver_scan(spark, sf_dir):
    """Raw bars landed per class, historical and daily, refined to silver, scanned back."""
    bars = event_bars(spark, sf_dir)
    raw = bars.select(
        F.col("date").cast("timestamp_ntz").alias("date"), "open", "high", "low", "close",
        (F.col("close") / 2).alias("adj_close"), "volume", F.upper("series").alias("ticker"),
        F.lit("2024-02-01T00:00:00").alias("fetch_timestamp"),
        _label("series", EVENT_CLASSES).alias("asset_class"),
        F.lit("yfinance").alias("source"),
    )
    root = scratch_path(spark, "lake")
    early = cleanse.clip_dates(raw, end="2024-01-28")
    late = cleanse.clip_dates(raw, start="2024-01-29")
    sink.write_raw(early.withColumn("load_type", F.lit("historical")), root, "historical")
    sink.write_raw(late.withColumn("load_type", F.lit("daily")), root, "daily")
    run_silver(spark, root, "yfinance", "historical")
    for day in ("2024-01-29", "2024-01-30"):
        run_silver(spark, root, "yfinance", "daily", day)
    silver = lake.scan_layer(spark, root, "transformed", SILVER_PRICES, "yfinance")
    return silver.drop("transform_timestamp")


@register
def lake_macro_scan(spark, sf_dir):
    """Two macro sources landed by data date, one below a provider and flat, scanned as one."""
    rows = macro_rows(spark, sf_dir).select(
        F.col("series").alias("series_id"),
        F.col("date").cast("timestamp_ntz").alias("date"),
        "value",
        F.lit("2024-02-01T00:00:00").alias("fetch_timestamp"),
        F.lit("economic").alias("asset_class"),
        F.lit("historical").alias("load_type"),
    )
    root = scratch_path(spark, "lake")
    for flag, source, provider in (("R", "fred", None), ("A", "dbnomics", "imf"), ("N", "dbnomics", None)):
        part = rows.where(F.col("series_id") == flag).withColumns(
            {"source": F.lit(source), "provider": F.lit(provider).cast("string")}
        )
        sink.write_raw(part, root, "historical", provider=provider is not None)
    for source in ("fred", "dbnomics"):
        run_silver(spark, root, source, "historical")
    return lake.scan_macro(spark, root, "transformed", SILVER_MACRO).select(
        "date", "indicator", "value", "asset_class", "data_source", "provider", "load_type"
    )


@register
def stream_daily_upsert(spark, sf_dir):
    """Events arrive as daily files; the stream keeps each user's newest event per day."""
    events = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    inbox, target, position = (scratch_path(spark, n) for n in ("inbox", "landed", "position"))
    ingest.day_files(events, inbox)
    current = ingest.ingest_available(
        spark, inbox, events.schema, target, position, ["user_id", "date"], ["ts", "event_id"],
        files_per_batch=16,
    )
    return current.select("user_id", "date", "event_id", "event_type", "value")


# -- landed documents, outcomes, audit -----------------------------------------------------


def _documents(rows: DataFrame, path: str, *folders: str) -> None:
    """JSON arrays of the rows' other columns, one document to a file."""
    fields = [c for c in rows.columns if c not in (*folders, "document")]
    docs = rows.groupBy(*folders, "document").agg(F.to_json(F.collect_list(F.struct(*fields)), {"ignoreNullFields": "false"}).alias("value"))
    docs.select("value", *folders).write.partitionBy(*folders).option("maxRecordsPerFile", 1).text(path)


@register
def coin_pages_until_threshold(spark, sf_dir):
    """Landed pages in order of volume, up to the first with a coin below the threshold; some coins land late."""
    volume = F.coalesce("total_volume", F.lit(0.0))
    key = F.substring("id", 6, 12).cast("bigint")
    page = 1 + F.floor(F.greatest(F.lit(0.0), 4_000_000 - volume) / 250_000) + F.when(key % 97 == 0, 15).otherwise(0)
    path = scratch_path(spark, "pages")
    _documents(coin_markets(spark, sf_dir).withColumns({"page": page, "document": F.floor(key / 250)}), path, "page")
    return universe.coin_universe(documents.until_below(documents.coin_pages(spark, path)))


@register
def exchange_symbol_files(spark, sf_dir):
    """Symbol files landed by exchange, read back: a later exchange replaces an earlier one's symbol."""
    rows = listings(spark, sf_dir).withColumn("document", F.pmod(F.xxhash64("symbol"), F.lit(16)))
    path = scratch_path(spark, "symbols")
    _documents(rows, path, "exchange")
    return universe.listed_symbols(documents.read_listings(spark, {e: f"{path}/exchange={e}" for e in ("nasdaq", "nyse", "amex")}))


@register
def series_lists(spark, sf_dir):
    """Identifiers of flat and of grouped lists in JSON documents; groups that begin with _ are comments."""
    k = F.col("o_custkey")
    group = F.when(k % 5 == 0, F.lit("_note")).otherwise(F.concat(F.lit("Group"), k % 7))
    docs = table(spark, sf_dir, "orders").select(F.to_json(F.struct(
        F.struct(F.array(F.concat(F.lit("F-"), k), F.col("o_orderpriority")).alias("fred_all")).alias("simplified_lists"),
        F.create_map(group, F.struct(F.array(
            F.struct(F.concat(F.lit("D-"), k).alias("id")), F.struct(F.lit(None).cast("string").alias("id")),
        ).alias("series"))).alias("dbnomics_exclusive"),
    )).alias("value"))
    flat = documents.flat_list_ids(docs, "simplified_lists", "fred_all").select(F.lit("fred").alias("group"), "series_id")
    return flat.unionByName(documents.grouped_ids(docs, "dbnomics_exclusive").distinct())


@register
def run_outcomes(spark, sf_dir):
    """A run of one group, named in another case: success, failure and skipped groups with their names."""
    orders = table(spark, sf_dir, "orders")
    groups = orders.groupBy(F.concat(F.lit("Group"), F.col("o_custkey") % 7).alias("group")).agg(
        F.count_if(F.col("o_orderstatus") == "P").alias("series_count"), F.count("*").alias("records")
    ).withColumn("series_count", F.when(F.col("group") == "Group3", 0).otherwise(F.col("series_count")))
    results = groups.where("group <> 'Group5'").select(
        "group", F.when(F.col("group") == "Group2", "failed").otherwise("success").alias("status"), "records"
    )
    every = state.group_outcomes(state.select_groups(groups), results)
    one = state.group_outcomes(state.select_groups(groups, "gROUP4"), results)
    return state.named_summary(every).withColumn("selector", F.lit("all")).unionByName(
        state.named_summary(one).withColumn("selector", F.lit("gROUP4"))
    )


@register
def audit_stamp(spark, sf_dir):
    """Silver rows without a given stamp carry one time of the query, and it is now."""
    silver = cleanse.silver_macro(macro_rows(spark, sf_dir).withColumnRenamed("series", "series_id"), "economic", "fred", "historical")
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("transform_timestamp")
    return silver.groupBy("indicator").agg(
        F.count("*").alias("observations"), F.count_distinct("transform_timestamp").alias("stamps"),
        (F.max(F.abs(age)) < 3600).alias("fresh"),
    )


@register
def published_order(spark, sf_dir):
    """Place of each date in the published Parquet file."""
    rows = gold_plan.curated_panel(*silver_standins(spark, sf_dir), floor=GOLD_FLOOR)
    root = scratch_path(spark, "lake")
    wide = panel.pivot_wide(panel.keep_weekdays(rows), BASE_COLUMNS)
    parquet, _ = sink.write_published(wide, root)
    return spark.read.parquet(parquet).select("date", F.col("_metadata.row_index").alias("place"))


@register
def late_arrivals(spark, sf_dir):
    """Two passes of a stream: one series' values of a year come late, the last days come again."""
    rows = order_panel(spark, sf_dir).withColumn("version", F.lit(1))
    behind = (F.col("series") == "1-URGENT") & (F.year("date") == 1996)
    source, target, checkpoint = (scratch_path(spark, name) for name in ("arrivals", "stream", "marks"))
    for batch in (rows.where(~behind), rows.where(behind | (F.col("date") >= "2001-07-20"))):
        batch.coalesce(2).write.mode("append").parquet(source)
        late.land_under_watermark(
            ingest.file_stream(spark, source, rows.schema), target, checkpoint, ["series", "date"], ["version"], 30
        ).awaitTermination()
    settled = late.settled_rows(spark, target, rows.schema, ["series", "date"], ["version"])
    landed = late.landed_rows(spark, target, rows.schema)
    windows = late.late_windows(late.late_rows(spark, target, rows.schema))
    counted = settled.groupBy("series").agg(F.count("*").alias("days"), F.sum("value").alias("total"))
    batches = landed.groupBy("series").agg(F.count("*").alias("in_time"))
    return rounded(counted.join(batches, "series").join(windows, "series", "left"), 2, "total")


@register
def append_after_stored_mark(spark, sf_dir):
    """Rows after the newest date of a stored table; the mark is read from its footers."""
    daily = _daily_orders(spark, sf_dir)
    path = scratch_path(spark, "stored")
    cleanse.clip_dates(daily, end="2000-12-31").write.parquet(path)
    return marks.newer_than_stored(daily, path, daily.schema)


@register
def distinct_series_of_spans(spark, sf_dir):
    """Users of each event type over two spans from stored daily sketches, held against the exact counts."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_type", "user_id")
    daily = materialize(sketches.daily_sketches(events, F.col("user_id").cast("bigint"), "event_type"), "sketches")
    out = []
    for name, start, end in (("first_half", "2024-01-01", "2024-01-15"), ("all", "2024-01-01", "2024-12-31")):
        exact = cleanse.clip_dates(events, start, end).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
        near = sketches.span_counts(daily, start, end, "event_type").join(exact, "event_type")
        within = F.abs(F.col("series_count") - F.col("users")) <= 4 * sketches.STANDARD_ERROR * F.col("users") + 0.5
        out.append(near.select(F.lit(name).alias("span"), "event_type", "rows", "users", within.alias("within_bound")))
    return resolve.union_all(out)
