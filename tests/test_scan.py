import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import scan


def ticks(seed=3, rows=3000):
    """One hot series, small ones, a series without values, and ties in the first order column."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        series = "hot" if rng.random() < 0.7 else f"s{rng.integers(0, 20)}"
        value = None if rng.random() < 0.3 or series == "s3" else float(rng.integers(-5, 100))
        out.append((series, int(rng.integers(0, rows // 3)), i, value))
    return out + [(None, 5, -1, 1.0), (None, 6, -2, None), ("hot", None, -3, 50.0), ("one", 7, -4, 2.0)]


SCHEMA = "series string, at int, id int, value double"
FOLDS = {
    "filled": ("last", "value"), "first": ("first", "value"), "peak": ("max", "value"), "low": ("min", "value"),
    "total": ("sum", "value"), "known": ("count", "value"),
}


def brute(rows):
    out, state = {}, {}
    for series, at, i, value in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        seen = state.setdefault(series, [])
        if value is not None:
            seen.append(value)
        out[i] = (seen[-1], seen[0], max(seen), min(seen), sum(seen), len(seen)) if seen else (None,) * 5 + (0,)
    return out


@pytest.mark.parametrize("segments", [1, 2, 7, 64])
def test_running_against_a_loop(spark, segments):
    rows = ticks()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = scan.running(df, FOLDS, ["at", "id"], segments=segments)
    assert got.columns == ["series", "at", "id", "value", *FOLDS]
    assert {r.id: tuple(r)[4:] for r in got.collect()} == brute(rows)


def test_segments_split_the_hot_series(spark, plan):
    df = spark.createDataFrame(ticks(), SCHEMA)
    bounds = scan.boundaries(df, "at", 50)
    sizes = df.groupBy("series", scan.segment_of("at", bounds).alias("segment")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 3004 / 50  # of 2100 rows
    text = plan(scan.running(df, FOLDS, ["at", "id"], segments=50))
    rows_by = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert rows_by and all("_segment" in line for line in rows_by)


def test_nothing_and_nothing_known(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert scan.running(none, FOLDS, ["at", "id"]).count() == 0
    blank = spark.createDataFrame([("a", 1, 1, None), ("a", 2, 2, None)], SCHEMA)
    assert {(r.filled, r.known) for r in scan.running(blank, FOLDS, ["at", "id"]).collect()} == {(None, 0)}


def test_metrics_equal_the_windows_of_a_panel(spark):
    rng = np.random.default_rng(1)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(300)]
    rows = [(s, d, None if rng.random() < 0.2 else float(p)) for s in "ab" for d, p in zip(days, 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 300))))]
    got = scan.running_metrics(spark.createDataFrame(rows, "series string, date date, value double"), segments=9).toPandas()
    df = pd.DataFrame(rows, columns=["series", "date", "value"]).sort_values(["series", "date"]).set_index(["series", "date"])
    got = got.sort_values(["series", "date"]).set_index(["series", "date"])
    by = df.groupby("series").value
    pd.testing.assert_series_equal(got.filled, by.ffill(), check_names=False)
    first = by.transform(lambda v: v.dropna().iloc[0])
    np.testing.assert_allclose(got.norm, df.value / first * 100)
    np.testing.assert_allclose(got.drawdown, df.value / by.cummax() - 1, atol=1e-12)
