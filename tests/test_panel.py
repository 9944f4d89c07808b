import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import panel, quality, resolve, upsert
from tideline.schemas import inline_rows, series_dimension, series_rows

D = dt.date
PANEL = "series string, date date, value double"


def frame(spark, rows, schema=PANEL):
    return spark.createDataFrame(rows, schema)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def sparse_rows(seed=3):
    rng = np.random.default_rng(seed)
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    return [
        (s, d, float(i * 100 + j))
        for i, s in enumerate("abcd")
        for j, d in enumerate(days)
        if rng.random() < 0.3
    ]


def test_densify_equals_grid_join(spark):
    rows = sparse_rows()
    got = as_set(panel.densify(frame(spark, rows)), "series", "date", "value")
    known = {(s, d): v for s, d, v in rows}
    grid = itertools.product({s for s, _, _ in rows}, {d for _, d, _ in rows})
    assert got == {(s, d, known.get((s, d))) for s, d in grid}


def test_densify_with_given_calendar(spark):
    rows = [("a", D(2024, 1, 2), 1.0), ("a", D(2024, 1, 9), 2.0)]
    calendar = frame(spark, [(D(2024, 1, i),) for i in (1, 2, 3)], "date date")
    out = panel.densify(frame(spark, rows), calendar=calendar)
    assert as_set(out, "date", "value") == {
        (D(2024, 1, 1), None), (D(2024, 1, 2), 1.0), (D(2024, 1, 3), None),
    }


def test_densify_repeats_kept_columns_and_null_values(spark):
    rows = [("a", "x", D(2024, 1, 1), None), ("b", "y", D(2024, 1, 2), 3.0)]
    df = frame(spark, rows, "series string, kind string, date date, value double")
    assert as_set(panel.densify(df, keep=["kind"]), "series", "kind", "date", "value") == {
        ("a", "x", D(2024, 1, 1), None), ("a", "x", D(2024, 1, 2), None),
        ("b", "y", D(2024, 1, 1), None), ("b", "y", D(2024, 1, 2), 3.0),
    }


def test_densify_plan_has_no_pairing_join(spark, plan):
    text = plan(panel.densify(frame(spark, sparse_rows())))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_fill_forward_only_named_series(spark):
    rows = [("a", D(2024, 1, 1), 1.0), ("b", D(2024, 1, 1), 2.0), ("c", D(2024, 1, 2), 3.0)]
    dense = panel.densify(frame(spark, rows))
    filled = panel.fill_forward(dense, only=F.col("series") == "a")
    assert {r.series: r.value for r in filled.where("date = DATE'2024-01-02'").collect()} == {"a": 1.0, "b": None, "c": 3.0}


def test_weekend_rows_are_dropped(spark):
    rows = [("a", D(2024, 1, 5), 1.0), ("a", D(2024, 1, 6), 2.0), ("a", D(2024, 1, 7), 3.0)]
    assert panel.keep_weekdays(frame(spark, rows)).count() == 1


def test_daily_bars(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(t(1), 5.0, 2), (t(1), 4.0, 1), (t(2), 9.0, 3), (t(3), 1.0, 4), (t(3), 2.0, 5)]
    ticks = frame(spark, rows, "ts timestamp_ntz, p double, id bigint")
    bar = panel.daily_bars(ticks, F.lit("s"), "ts", "p", "id").first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (4.0, 9.0, 1.0, 2.0, 5)


def test_pivot_unpivot_round_trip(spark):
    rows = sparse_rows()
    wide = panel.pivot_wide(frame(spark, rows), list("abcd"))
    assert wide.columns == ["date", "a", "b", "c", "d"]
    assert as_set(panel.unpivot_grid(wide, ["date"], list("abcd")), "series", "date", "value") == set(rows)


def test_outer_merge_equals_full_joins(spark):
    rows = sparse_rows()
    parts = [frame(spark, [r for r in rows if r[0] == s]) for s in "abc"]
    merged = panel.outer_merge(parts, list("abc"))
    joined = parts[0].select("date", F.col("value").alias("a"))
    for s, p in zip("bc", parts[1:]):
        joined = joined.join(p.select("date", F.col("value").alias(s)), "date", "full")
    assert as_set(merged, "date", "a", "b", "c") == as_set(joined, "date", "a", "b", "c")


def test_grid_to_bars_drops_unpriced(spark):
    df = frame(spark, [(D(2024, 1, 1), 1.0, 2, None, 5)], "date date, `A|close` double, `A|volume` int, `B|close` double, `B|volume` int")
    assert as_set(panel.grid_to_bars(df, ["A", "B"], ["close", "volume"]), "ticker", "close", "volume") == {("A", 1.0, 2)}


def test_price_gap(spark):
    rows = [("y", D(2024, 1, 1), 100.0), ("c", D(2024, 1, 1), 99.0), ("y", D(2024, 1, 2), 0.0), ("c", D(2024, 1, 2), 1.0), ("y", D(2024, 1, 3), 5.0)]
    out = {r.date.day: (r["diff"], r.diff_pct) for r in panel.price_gap(frame(spark, rows), "y", "c").collect()}
    assert out == {1: (1.0, 1.0), 2: (-1.0, None), 3: (None, None)}


def test_map_series_filters_and_pushes_down(spark, tmp_path, plan):
    ids = [("yfinance", "^GSPC"), ("cryptocompare", "BTC-USD"), ("yfinance", "BTC-USD"), ("yfinance", "NOPE")]
    rows = frame(spark, ids, "source string, series_id string")
    rows.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    out = panel.map_series(stored, series_dimension(spark), "series_id", sorted({r[1] for r in series_rows()}))
    assert as_set(out, "source", "series") == {
        ("yfinance", "sp500"), ("cryptocompare", "bitcoin_price_cc"), ("yfinance", "bitcoin_price"),
    }
    text = plan(out)
    assert "In(series_id" in text and "BroadcastHashJoin" in text


def test_keep_last_ties_and_hot_key(spark, plan):
    rows = [("hot", i % 100, i) for i in range(3000)] + [("cold", 1, 1), ("cold", 1, 2)]
    df = frame(spark, rows, "k string, v int, id int")
    out = resolve.keep_last(df, ["k"], ["v", "id"])
    assert as_set(out, "k", "v", "id") == {("hot", 99, 2999), ("cold", 1, 2)}
    assert plan(out).count("WindowGroupLimit") == 2


def test_keep_preferred_null_rank_last(spark):
    rows = [("a", None, 1.0), ("a", 2, 2.0), ("a", 1, 3.0), ("b", None, 4.0)]
    df = frame(spark, rows, "k string, rank int, v double")
    assert as_set(resolve.keep_preferred(df, ["k"], "rank", ["v"]), "k", "v") == {("a", 3.0), ("b", 4.0)}


def test_union_all_fills_missing(spark):
    out = resolve.union_all([frame(spark, [(1, 2)], "a int, b int"), frame(spark, [(3, 4)], "a int, c int")])
    assert as_set(out, "a", "b", "c") == {(1, 2, None), (3, None, 4)}


def test_merge_pages(spark):
    page = frame(spark, [(D(2024, 1, 1), "BTC"), (D(2024, 1, 2), "BTC")], "date date, symbol string")
    assert resolve.merge_pages([page, page], ["date", "symbol"]).count() == 2


GOLD = "date date, a double, b double"


def test_upsert_is_idempotent_and_replaces_whole_rows(spark):
    old = frame(spark, [(D(2024, 1, 1), 1.0, 1.0), (D(2024, 1, 2), 2.0, 2.0)], GOLD)
    new = frame(spark, [(D(2024, 1, 2), 9.0), (D(2024, 1, 3), 3.0)], "date date, a double")
    once = upsert.upsert_rows(old, new)
    want = {(D(2024, 1, 1), 1.0, 1.0), (D(2024, 1, 2), 9.0, None), (D(2024, 1, 3), 3.0, None)}
    assert as_set(once, "date", "a", "b") == want
    twice = upsert.upsert_rows(once, new)
    assert as_set(twice, "date", "a", "b") == want and twice.count() == 3


def test_upsert_cells_keeps_old_where_new_is_null(spark):
    old = frame(spark, [(D(2024, 1, 1), 1.0, 2.0)], GOLD)
    new = frame(spark, [(D(2024, 1, 1), None, 9.0), (D(2024, 1, 2), 3.0, None)], GOLD)
    assert as_set(upsert.upsert_cells(old, new), "date", "a", "b") == {(D(2024, 1, 1), 1.0, 9.0), (D(2024, 1, 2), 3.0, None)}


def test_newer_than_pushes_the_mark_to_the_scan(spark, tmp_path):
    df = frame(spark, [(D(2024, 1, i), float(i), 0.0) for i in range(1, 11)], GOLD)
    df.write.parquet(str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    out = upsert.newer_than(stored, stored.where("date <= DATE'2024-01-08'"))
    assert {r.date.day for r in out.collect()} == {9, 10}
    empty_target = stored.where("a < 0")
    assert upsert.newer_than(stored, empty_target).count() == 10
    assert upsert.high_water_mark(empty_target).first().max_date is None


def test_correlation_matrix_matches_pandas(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(200, 3))
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in data] + [(None, None, None)]
    df = frame(spark, rows, "a double, b double, c double")
    want = df.toPandas().astype(float).corr()
    for r in quality.correlation_matrix(df, ["a", "b", "c"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r.left_series, r.right_series], abs=1e-9)


def test_performance_ranks_ties(spark):
    ends = {"a": (1.0, 2.0), "b": (2.0, 4.0), "c": (1.0, 3.0), "d": (0.0, 1.0)}
    rows = [(s, D(2024, 1, day), v) for s, pair in ends.items() for day, v in zip((1, 9), pair)]
    out = {r.series: (r.total_return, r["rank"]) for r in quality.performance(frame(spark, rows), "2024-01-01", "2024-12-31").collect()}
    assert out == {"c": (2.0, 1), "a": (1.0, 2), "b": (1.0, 2), "d": (None, 4)}


def test_monthly_trend_does_not_bridge_missing_months(spark):
    rows = [("a", D(2023, 1, 5), 1.0), ("a", D(2023, 2, 5), 2.0), ("a", D(2023, 4, 5), 3.0), ("a", D(2024, 1, 5), 4.0)]
    out = {r.month: (r.mom, r.yoy) for r in quality.monthly_trend(frame(spark, rows)).collect()}
    assert out == {D(2023, 1, 1): (None, None), D(2023, 2, 1): (1.0, None), D(2023, 4, 1): (None, None), D(2024, 1, 1): (None, 3.0)}


def test_series_quality(spark):
    rows = [("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 1), None), ("a", D(2024, 1, 20), 2.0)]
    r = quality.series_quality(frame(spark, rows), F.lit("2024-02-01").cast("date")).first()
    assert (r.row_count, r.null_rate, r.gaps, r.duplicate_rows, r.days_stale) == (3, pytest.approx(1 / 3), 1, 1, 12)


def test_align_pairs_keeps_one_sided_dates(spark):
    rows = [("a", D(2024, 1, 1), 1.0), ("b", D(2024, 1, 1), 2.0), ("a", D(2024, 1, 2), 3.0)]
    pairs = inline_rows(spark, [("p", "a", "b"), ("self", "a", "a")], "pair string, left_series string, right_series string")
    assert as_set(panel.align_pairs(frame(spark, rows), pairs), "pair", "date", "x", "y") == {
        ("p", D(2024, 1, 1), 1.0, 2.0), ("p", D(2024, 1, 2), 3.0, None),
        ("self", D(2024, 1, 1), 1.0, 1.0), ("self", D(2024, 1, 2), 3.0, 3.0),
    }
