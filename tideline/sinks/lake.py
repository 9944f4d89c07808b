"""Writers of the layered lake and the published table."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

ROWS_PER_FILE = 100_000


def _day_keys(df: DataFrame) -> DataFrame:
    """Zero-padded date folders, so that paths sort by date."""
    return df.withColumns({
        "year": F.date_format("date", "yyyy"),
        "month": F.date_format("date", "MM"),
        "day": F.date_format("date", "dd"),
    })


def observed(seen: Observation, name: str) -> int:
    """Observed count; a plan reduced to an empty relation reports no metrics at all."""
    try:
        return seen.get[name]
    except (Py4JJavaError, KeyError):
        return 0


def write_layer(
    df: DataFrame,
    root: str,
    layer: str,
    by_day: bool,
    provider: bool = False,
    rows_per_file: int | None = None,
    append: bool = False,
) -> int:
    """Write rows below ``root/layer`` and return how many were written.

    Exactly the folders present in ``df`` are replaced, so a re-run is
    idempotent; ``append`` adds files to them instead. ``by_day`` writes one
    folder per data date: rows are rebalanced on the folder keys first, which
    gives few files per folder and splits a folder that is too big for one task.
    Otherwise the tasks that read the rows write them, without a shuffle.
    """
    keys = ["asset_class", "source"] + (["provider"] if provider else []) + ["load_type"]
    if by_day:
        df = _day_keys(df)
        keys += ["year", "month", "day"]
    else:
        df = df.drop("year", "month", "day")
    if not provider:
        df = df.drop("provider")
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if by_day:
        out = out.hint("rebalance", *keys)
    writer = out.write.partitionBy(*keys).option("compression", "snappy")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer = writer.option("partitionOverwriteMode", "dynamic").mode("append" if append else "overwrite")
    writer.parquet(f"{root.rstrip('/')}/{layer}")
    return observed(seen, "rows")


def write_raw(df: DataFrame, root: str, load_type: str, provider: bool = False) -> int:
    """Landed rows: backfill batches add up, a daily load replaces the days it brings."""
    daily = load_type == "daily"
    return write_layer(df, root, "raw", by_day=daily, provider=provider, append=not daily)


def write_silver(df: DataFrame, root: str, load_type: str, provider: bool = False) -> int:
    """Silver rows, about 100,000 to a file; a re-run replaces what it wrote before."""
    return write_layer(
        df, root, "transformed", by_day=load_type == "daily", provider=provider, rows_per_file=ROWS_PER_FILE
    )


def write_published(gold: DataFrame, root: str, name: str = "macro_market_merged") -> tuple[str, str]:
    """Publish the wide table as Parquet and as CSV with a header.

    The rebalance puts a table of ordinary length into a single file and splits
    a longer one. The CSV is written from the Parquet just published, not by a
    second run of the plan.
    """
    base = f"{root.rstrip('/')}/curated/{name}"
    parquet, csv = f"{base}.parquet", f"{base}.csv"
    gold.hint("rebalance").sortWithinPartitions("date").write.mode("overwrite").parquet(parquet)
    published = gold.sparkSession.read.schema(gold.schema).parquet(parquet)
    published.hint("rebalance").sortWithinPartitions("date").write.mode("overwrite").option(
        "header", "true"
    ).csv(csv)
    return parquet, csv


def write_universe(universe: DataFrame, header: DataFrame, path: str) -> None:
    """Publish a universe as JSON lines with its one-row header beside it.

    One line per instrument, so the file is read and written in parallel
    whatever its length.
    """
    universe.write.mode("overwrite").json(f"{path}/rows")
    header.write.mode("overwrite").json(f"{path}/header")
