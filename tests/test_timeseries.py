"""Rolling semantics against pandas on random panels with gaps and constant runs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.timeseries import base_100, by_series, drawdown, ffill, pct_change, rolling_std
from tideline.operators.metrics import add_metrics, pair_correlation
from tideline.operators.rolling import correlation_of, trailing_moments, zscore_of
from tideline.schemas import inline_rows

DAYS = 700


def random_panel(seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    dates = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(DAYS)]
    frames = []
    for name in ("a", "b", "c"):
        v = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, DAYS)))
        v[rng.random(DAYS) < 0.15] = np.nan
        v[: rng.integers(0, 40)] = np.nan
        if name == "c":
            v[200:520] = 5.25
        frames.append(pd.DataFrame({"series": name, "date": dates, "value": v}))
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf):
    rows = [
        (s, d, None if np.isnan(v) else float(v))
        for s, d, v in pdf[["series", "date", "value"]].itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "series string, date date, value double")


def collect(df, column):
    out = df.select("series", "date", column).orderBy("series", "date").toPandas()[column]
    return out.to_numpy(dtype=float, na_value=np.nan)


def by_pandas(pdf, fn):
    return np.concatenate([fn(g["value"].reset_index(drop=True)).to_numpy() for _, g in pdf.groupby("series")])


def same(got, want, tolerance=1e-9):
    want = np.where(np.isinf(want), np.nan, want)
    np.testing.assert_array_equal(np.isnan(got), np.isnan(want))
    np.testing.assert_allclose(got, want, rtol=tolerance, atol=tolerance)


@pytest.fixture(params=[1, 2])
def panel(request, spark):
    pdf = random_panel(request.param)
    return pdf, to_spark(spark, pdf)


W = by_series


def test_ffill(panel):
    pdf, df = panel
    same(collect(df.withColumn("x", ffill("value", W())), "x"), by_pandas(pdf, lambda s: s.ffill()))


def test_pct_change(panel):
    pdf, df = panel
    padded = by_pandas(pdf, lambda s: s.ffill().pct_change(fill_method=None))
    same(collect(df.withColumn("x", pct_change("value", W())), "x"), padded)
    plain = by_pandas(pdf, lambda s: s.pct_change(fill_method=None))
    same(collect(df.withColumn("x", pct_change("value", W(), "none")), "x"), plain)


def test_pct_change_rejects_unknown_fill(spark):
    with pytest.raises(ValueError):
        pct_change("value", W(), "linear")


@pytest.mark.parametrize(("rows", "least"), [(7, 2), (30, 5)])
def test_rolling_std(panel, rows, least):
    pdf, df = panel
    want = by_pandas(pdf, lambda s: s.rolling(rows, min_periods=least).std())
    got = collect(df.withColumn("x", rolling_std("value", W(), rows, least)), "x")
    same(got, np.where(np.abs(want) < 1e-6, 0.0, want), 1e-6)


@pytest.mark.parametrize(("rows", "least"), [(252, 30), (1, 1), (2, 2), (700, 5), (1000, 30)])
def test_zscore_over_blocks(panel, rows, least):
    pdf, df = panel

    def want(s):
        r = s.rolling(rows, min_periods=least)
        z = (s - r.mean()) / r.std()
        flat = (r.max() == r.min()) & (s.rolling(rows, min_periods=least).count() >= least)
        z[flat] = 0.0
        return z

    m = trailing_moments(df, rows, "value")
    same(collect(m.withColumn("x", zscore_of(F.col("value"), F.col("moments"), least)), "x"), by_pandas(pdf, want), 1e-6)


def test_zscore_survives_outlier_leaving_the_window(spark):
    values = [1e12] + [1.0 + (i % 5) * 1e-3 for i in range(599)]
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, date date, value double")
    m = trailing_moments(df, 252, "value")
    got = collect(m.withColumn("x", zscore_of(F.col("value"), F.col("moments"), 30)), "x")
    for i in (300, 503, 504, 599):
        window = np.array(values[i - 251 : i + 1])
        assert got[i] == pytest.approx((values[i] - window.mean()) / window.std(ddof=1), rel=1e-9)


def test_correlation(spark, panel):
    pdf, df = panel
    pairs = inline_rows(spark, [("ab", "a", "b"), ("ac", "a", "c")], "pair string, left_series string, right_series string")
    out = pair_correlation(df.withColumnRenamed("value", "ret"), pairs)
    wide = pdf.pivot(index="date", columns="series", values="value")
    for pair, (x, y) in {"ab": "ab", "ac": "ac"}.items():
        got = out.where(F.col("pair") == pair).orderBy("date").toPandas()["corr"].to_numpy(float)
        want = []
        for i in range(DAYS):
            w = wide.iloc[max(0, i - 89) : i + 1].dropna(subset=[x, y])
            flat = len(w) < 30 or w[x].nunique() == 1 or w[y].nunique() == 1
            want.append(np.nan if flat else np.corrcoef(w[x], w[y])[0, 1])
        same(got, np.array(want), 1e-7)


def test_base_100_and_drawdown(panel):
    pdf, df = panel
    same(
        collect(df.withColumn("x", base_100("value", W())), "x"),
        by_pandas(pdf, lambda s: s / s.dropna().iloc[0] * 100),
    )
    same(
        collect(df.withColumn("x", drawdown("value", W())), "x"),
        by_pandas(pdf, lambda s: s / s.cummax().ffill() - 1),
    )


def test_zero_first_price_has_no_base(spark):
    df = spark.createDataFrame([("s", dt.date(2020, 1, 1), 0.0), ("s", dt.date(2020, 1, 2), 5.0)], "series string, date date, value double")
    out = df.select(base_100("value", W()).alias("n"), pct_change("value", W()).alias("r")).collect()
    assert [tuple(r) for r in out] == [(None, None), (None, None)]


def test_all_metrics_use_one_shuffle(spark, panel, plan):
    _, df = panel
    text = plan(add_metrics(df))
    assert text.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in text
    assert "Python" not in text


def test_series_do_not_leak(spark):
    rows = [("a", dt.date(2020, 1, 1), 1.0), ("b", dt.date(2020, 1, 1), None), ("b", dt.date(2020, 1, 2), 2.0)]
    df = spark.createDataFrame(rows, "series string, date date, value double")
    assert np.isnan(collect(df.withColumn("x", ffill("value", W())), "x")[1])


def test_correlation_below_minimum_is_null(spark):
    rows = [("p", dt.date(2020, 1, 1), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "pair string, date date, x double, y double")
    m = trailing_moments(df, 90, "x", "y", keys=["pair"])
    assert m.select(correlation_of(F.col("moments"), 30).alias("c")).first().c is None
