"""Market-shaped inputs derived from the driver tables.

Each builder reads whole tables; the matching CTEs are in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.panel import daily_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV per event type."""
    return daily_bars(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long gappy panel: last order value per priority and day."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")
    ).agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))


def macro_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly observations: mean quantity per return flag, dated on the first of the month."""
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.groupBy(
        F.col("l_returnflag").alias("series"),
        F.trunc(F.to_date("l_shipdate"), "month").alias("date"),
    ).agg(F.avg("l_quantity").alias("value"))


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second daily source: largest line value per line status and ship day."""
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.groupBy(
        F.col("l_linestatus").alias("series"), F.to_date("l_shipdate").alias("date")
    ).agg(F.max("l_extendedprice").alias("value"))


def status_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First daily source for the columns that ``ship_panel`` also feeds."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderstatus").alias("series"), F.to_date("o_orderdate").alias("date")
    ).agg(F.max("o_totalprice").alias("value"))
