"""Bounded recomputation of a table that is derived from a long panel.

A store keeps three Parquet tables below one folder, all partitioned by month:

``observed``  every (series, date, value) as landed: not filled, weekends included,
              with the source priority and version that won it
``carry``     for each month the few observations that all earlier months mean to a
              later one: the first and the last known one of each series, once among
              all days and once among weekdays
``table``     the derived rows by date

Fills, first prices and returns at a date depend on earlier history only through
the first and the last observation before some start, and trailing windows through
a fixed number of rows. So the carry of a month together with the observations
from that month on gives equal derived rows, once the longest window lies inside.

An append reads the months it touches, the months of the look-back before them, one month of the
carry, and what follows. It rewrites only the touched months of the observations and the months from
the first touched one on of the other two tables. Late and weekend values, rows of a less
preferred source and repeated batches all end in the table that one refresh
of all rows gives. What an append writes first is a copy, so a run that is cut off
can be repeated: observations are replaced by equal ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.scalar import is_weekday
from tideline.operators.panel import densify
from tideline.operators.resolve import first_per_key
from tideline.session import materialize

#: Rows that the longest trailing window needs before the first one that is computed.
LOOK_BACK = 252

def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


OBSERVED = _schema(
    series=T.StringType(), date=T.DateType(), value=T.DoubleType(), priority=T.IntegerType(),
    version=T.TimestampType(), month=T.IntegerType(),
)
CARRY = _schema(series=T.StringType(), date=T.DateType(), value=T.DoubleType(), month=T.IntegerType())

Compute = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Store:
    """The three tables below ``path``; ``schema`` is that of the derived rows, with a ``date``."""

    path: str
    schema: T.StructType

    def __post_init__(self):
        object.__setattr__(self, "path", self.path.rstrip("/"))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        schemas = {"observed": OBSERVED, "carry": CARRY, "table": T.StructType([*self.schema.fields, OBSERVED["month"]])}
        return spark.read.schema(schemas[name]).parquet(f"{self.path}/{name}")

    def months(self, spark: SparkSession, name: str = "observed") -> list[int]:
        """Months that a table has, from its folders alone; none if it is not there."""
        jvm = spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/month=*")
        files = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        return sorted(int(f.getPath().getName().split("=")[1]) for f in files.globStatus(pattern) or [])

    def table(self, spark: SparkSession) -> DataFrame:
        """The derived rows."""
        return self.read(spark, "table").drop("month")


def month_of(date: str | Column = "date") -> Column:
    return F.year(date) * 100 + F.month(date)


def month_start(month: int) -> Column:
    return F.make_date(F.lit(month // 100), F.lit(month % 100), F.lit(1))


def strongest(rows: DataFrame) -> DataFrame:
    """One row per series and date: known values first, then the preferred source, the newest version, the largest value."""
    return first_per_key(rows, ["series", "date"], [
        F.col("value").isNull(), F.col("priority").asc_nulls_last(), F.col("version").desc_nulls_last(),
        F.col("value").desc_nulls_last(),
    ])


def _dated(rows: DataFrame) -> DataFrame:
    """Observations with a date, and their month."""
    return rows.where("date IS NOT NULL").withColumn("month", month_of()).select(*OBSERVED.names)


def _write(df: DataFrame, path: str, everything: bool = False) -> None:
    """Replace the months in ``df`` (or the whole table), few files to a month."""
    df.hint("rebalance", "month").write.partitionBy("month").option(
        "partitionOverwriteMode", "static" if everything else "dynamic"
    ).mode("overwrite").parquet(path)


def _edges(observed: DataFrame) -> list[Column]:
    """First and last known observation, among all days and among weekdays."""
    point = F.struct("date", "value")
    known = F.col("value").isNotNull()
    out = []
    for name, where in (("all", known), ("weekday", known & is_weekday("date"))):
        out += [F.min(F.when(where, point)).alias(f"first_{name}"), F.max(F.when(where, point)).alias(f"last_{name}")]
    return out


def carried(observed: DataFrame, before: DataFrame | None, first: int, last: int) -> DataFrame:
    """The carry of the months after ``first`` up to the one after ``last``.

    ``observed`` are the rows from ``first`` on, ``before`` is the carry of ``first``.
    Rows of a month fold before the shuffle, so a series is as long as its months.
    """
    after = F.add_months(F.trunc("date", "month"), 1)
    sums = observed.groupBy("series", after.alias("as_of")).agg(*_edges(observed))
    if before is not None:
        sums = sums.unionByName(before.groupBy("series", month_start(first).alias("as_of")).agg(*_edges(before)))
    names = [c for c in sums.columns if c not in ("series", "as_of")]
    days = observed.sparkSession.range(0, 1, 1, 1).select(F.explode(F.sequence(
        month_start(first), F.add_months(month_start(last), 1), F.expr("INTERVAL 1 MONTH")
    )).alias("date"))
    dense = densify(sums.withColumnRenamed("as_of", "date"), names, days)
    so_far = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = dense.select("series", "date", *[
        (F.first if c.startswith("first") else F.last)(c, ignorenulls=True).over(so_far).alias(c) for c in names
    ])
    points = F.array_compact(F.array_distinct(F.array(*names)))
    return state.where(F.col("date") > month_start(first)).select(
        "series", month_of().alias("month"), F.inline(points)
    ).select("series", "date", "value", "month")


def look_back(spark: SparkSession, store: Store, first: int, rows: int = LOOK_BACK) -> int:
    """The latest month from which ``rows`` weekday dates or more lie before ``first``; else the earliest month.

    Counts dates in the months just before, over spans that double until they suffice.
    """
    earlier = [m for m in store.months(spark) if m < first]
    span = 1 + rows // 20
    while earlier:
        some = earlier[-span:]
        found = store.read(spark, "observed").where(F.col("month").isin(some) & is_weekday("date"))
        days = dict(found.groupBy("month").agg(F.count_distinct("date")).collect())
        total = 0
        for month in reversed(some):
            total += days.get(month, 0)
            if total >= rows:
                return month
        if len(some) == len(earlier):
            return earlier[0]
        span *= 2
    return first


def tail_panel(spark: SparkSession, store: Store, start: int) -> DataFrame:
    """Observations from month ``start`` on, and those that stand for all before."""
    rows = store.read(spark, "observed").where(F.col("month") >= start).select("series", "date", "value")
    before = store.read(spark, "carry").where(F.col("month") == start).select("series", "date", "value")
    return rows.unionByName(before) if start in store.months(spark, "carry") else rows


def rebuild(spark: SparkSession, store: Store, rows: DataFrame, compute: Compute) -> DataFrame:
    """Fill the store from all observations (``series, date, value, priority, version``) and return the derived rows.

    ``compute`` turns a (series, date, value) panel into the derived rows.
    """
    chosen = materialize(strongest(_dated(rows)), "observed")
    _write(chosen, f"{store.path}/observed", everything=True)
    months = store.months(spark)
    carry = carried(chosen, None, months[0], months[-1]) if months else spark.createDataFrame([], CARRY)
    _write(carry, f"{store.path}/carry", everything=True)
    derived = compute(chosen.select("series", "date", "value"))
    _write(derived.withColumn("month", month_of()), f"{store.path}/table", everything=True)
    return store.table(spark)


def append(spark: SparkSession, store: Store, rows: DataFrame, compute: Compute, rows_back: int = LOOK_BACK) -> DataFrame:
    """Add observations to the store and return the derived rows, equal to a rebuild from all of them."""
    had = store.months(spark)
    if not had:
        return rebuild(spark, store, rows, compute)
    fresh = materialize(_dated(rows), "fresh")
    touched = sorted(r.month for r in fresh.select("month").distinct().collect())
    if not touched:
        return store.table(spark)
    first, last = touched[0], max(touched[-1], had[-1])
    old = store.read(spark, "observed").where(F.col("month").isin(touched))
    merged = materialize(strongest(old.unionByName(fresh)), "merged")
    _write(merged, f"{store.path}/observed")

    since = store.read(spark, "observed").where(F.col("month") >= first)
    # the carry of the first touched month, or where rows had ended months before, of the month after them
    base = max((m for m in store.months(spark, "carry") if m <= first), default=None)
    before = None if base is None else store.read(spark, "carry").where(F.col("month") == base)
    _write(materialize(carried(since, before, base or first, last), "carry"), f"{store.path}/carry")

    start = look_back(spark, store, first, rows_back)
    derived = compute(tail_panel(spark, store, start)).where(F.col("date") >= month_start(first))
    _write(derived.withColumn("month", month_of()), f"{store.path}/table")
    return store.table(spark)
