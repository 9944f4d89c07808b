import datetime as dt

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import sketches
from tideline.sources import marks

D = dt.date


def test_marks_come_from_footers(spark, tmp_path, plan):
    path = str(tmp_path / "t")
    df = spark.range(5000).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("date"))
    df.repartition(4).write.parquet(path)
    with marks.footer_aggregates(spark):
        text = plan(marks.extremes(spark, path, df.schema, ["date", "id"]))
    assert "PushedAggregation: [COUNT(*), MIN(date), MAX(date), MIN(id), MAX(id)]" in text
    assert tuple(marks.stored_marks(spark, path, df.schema, ["date", "id"])) == (5000, D(2024, 1, 1), D(2024, 3, 30), 0, 4999)
    assert "PushedAggregation" not in plan(spark.read.parquet(path).agg(F.max("date")))  # settings are put back
    new = spark.createDataFrame([(1, D(2024, 3, 30)), (2, D(2024, 3, 31)), (3, None)], df.schema)
    assert [r.id for r in marks.newer_than_stored(new, path, df.schema).collect()] == [2]
    empty = str(tmp_path / "e")
    df.limit(0).write.parquet(empty)
    assert marks.newer_than_stored(new, empty, df.schema).count() == 3


def test_sketches_merge_within_the_stated_error(spark):
    rng = np.random.default_rng(2)
    rows = [(D(2024, 1, 1 + int(d)), "k" if k else "l", f"s{s}") for d, k, s in zip(rng.integers(0, 20, 60_000), rng.integers(0, 2, 60_000), rng.integers(0, 30_000, 60_000))]
    rows += [(D(2024, 2, 1), "k", None), (D(2024, 2, 1), "k", "one"), (D(2024, 2, 2), "k", "one")]
    df = spark.createDataFrame(rows, "date date, kind string, series string").repartition(6)
    daily = sketches.daily_sketches(df, "series", "kind")
    for start, end in (("2024-01-01", "2024-01-20"), ("2024-01-05", "2024-01-06"), ("2024-02-01", "2024-02-09"), ("2025-01-01", "2025-01-02")):
        got = {r.kind: (r.rows, r.series_count) for r in sketches.span_counts(daily, start, end, "kind").collect()}
        inside = [r for r in rows if start <= str(r[0]) <= end]
        assert set(got) == {r[1] for r in inside}
        for kind, (n, estimate) in got.items():
            exact = len({r[2] for r in inside if r[1] == kind and r[2] is not None})
            assert n == sum(r[1] == kind for r in inside)
            assert abs(estimate - exact) <= max(4 * sketches.STANDARD_ERROR * exact, 0), (exact, estimate)
    months = sketches.merge_sketches(daily.withColumn("month", F.trunc("date", "month")), "month")
    assert {r[0]: r[1] for r in months.select("month", "rows").collect()} == {D(2024, 1, 1): 60_000, D(2024, 2, 1): 3}
    assert max(r[0] for r in months.select(F.length("sketch")).collect()) <= 2**sketches.LG_K + 100
    assert isinstance(daily.schema["sketch"].dataType, T.BinaryType)
