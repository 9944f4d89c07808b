"""Reads from the warehouse over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POSTGRES_DRIVER = "org.postgresql.Driver"


def connection(url: str, user: str, password: str, driver: str = POSTGRES_DRIVER) -> dict[str, str]:
    return {"url": url, "user": user, "password": password, "driver": driver}


def mark_query(table: str, column: str = "date") -> str:
    """Derived table holding the newest key, so the database sends back one row."""
    return f"(SELECT MAX({column}) AS max_{column} FROM {table}) AS t"


def read_mark(spark: SparkSession, conn: dict[str, str], table: str, column: str = "date") -> DataFrame:
    return spark.read.format("jdbc").options(**conn).option("dbtable", mark_query(table, column)).load()
