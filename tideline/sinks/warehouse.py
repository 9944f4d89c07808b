"""Warehouse loading: schema reconciliation and JDBC writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.cleanse import lower_names
from tideline.operators.upsert import newer_than
from tideline.schemas import conform, gold_schema
from tideline.sources.jdbc import read_mark

FULL_LOAD_PARTITIONS = 8


def reconcile(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Warehouse column set and order: missing columns NULL, unknown ones dropped."""
    df = lower_names(df)
    if "date" not in df.columns:
        raise ValueError("the published table must have a 'date' column")
    return conform(df.withColumn("date", F.to_date("date")), schema or gold_schema())


# Column types of the warehouse.
SQL_TYPES = {"date": "DATE", "double": "DOUBLE PRECISION"}


def _column_sql(field: T.StructField) -> str:
    return f"{field.name} {SQL_TYPES[field.dataType.typeName()]}"


def create_table_sql(table: str, schema: T.StructType | None = None) -> str:
    """DDL of the warehouse table."""
    columns = ",\n".join(f"    {_column_sql(f)}" for f in (schema or gold_schema()).fields)
    return f"CREATE TABLE {table} (\n{columns}\n)"


def alter_table_sql(
    table: str, existing: Sequence[str], schema: T.StructType | None = None
) -> list[str]:
    """Statements that bring a table with ``existing`` columns to the current column set."""
    fields = (schema or gold_schema()).fields
    wanted = {f.name for f in fields}
    return [
        f"ALTER TABLE {table} ADD COLUMN {_column_sql(f)}" for f in fields if f.name not in existing
    ] + [f"ALTER TABLE {table} DROP COLUMN {c}" for c in existing if c not in wanted]


def full_load_options(conn: dict[str, str], table: str) -> dict[str, str]:
    """Options of the truncating full load, written over a fixed number of connections."""
    return {
        **conn,
        "dbtable": table,
        "truncate": "true",
        "numPartitions": str(FULL_LOAD_PARTITIONS),
    }


def load_full(df: DataFrame, conn: dict[str, str], table: str) -> None:
    """Replace the table's contents, keeping its definition."""
    out = reconcile(df).repartition(FULL_LOAD_PARTITIONS)
    out.write.format("jdbc").options(**full_load_options(conn, table)).mode("overwrite").save()


def append_options(conn: dict[str, str], table: str) -> dict[str, str]:
    return {**conn, "dbtable": table, "numPartitions": "1"}


def rows_to_append(df: DataFrame, mark: DataFrame) -> DataFrame:
    """Rows newer than the warehouse's newest date.

    ``mark`` is any frame with a ``date`` column, the target itself or the
    one-row mark read from it.
    """
    return newer_than(reconcile(df), mark)


def append_new(df: DataFrame, conn: dict[str, str], table: str) -> bool:
    """Append what is newer than the table's newest date; False when there is nothing."""
    mark = read_mark(df.sparkSession, conn, table).withColumnRenamed("max_date", "date")
    fresh = rows_to_append(df, mark)
    if fresh.isEmpty():
        return False
    fresh.repartition(1).write.format("jdbc").options(**append_options(conn, table)).mode("append").save()
    return True
