import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.timeseries import base_100, by_series
from tideline.plans import carry, gold
from tideline.plans.silver import run_silver
from tideline.plans.warehouse import published_rows
from tideline.schemas import (
    BASE_COLUMNS,
    MACRO_COLUMNS,
    SILVER_CRYPTO,
    SILVER_MACRO,
    SILVER_PRICES,
    conform,
    derived_columns,
    gold_schema,
    series_rows,
)
from tideline.sinks import lake as sink
from tideline.sources import lake, landing

D = dt.date
TS = dt.datetime


def prices(spark, rows):
    df = spark.createDataFrame(rows, "date date, ticker string, close double, transform_timestamp timestamp")
    return conform(df, SILVER_PRICES)


def crypto(spark, rows):
    df = spark.createDataFrame(rows, "date date, ticker string, close double, transform_timestamp timestamp")
    return conform(df, SILVER_CRYPTO)


def macro(spark, rows):
    df = spark.createDataFrame(rows, "date date, indicator string, value double, data_source string")
    return conform(df, SILVER_MACRO).withColumn("data_source", F.when(F.col("indicator").contains("/"), "dbnomics").otherwise("fred"))


def test_column_inventory():
    assert len(BASE_COLUMNS) == 38 and len(MACRO_COLUMNS) == 25 and len(derived_columns()) == 57
    assert len(set(gold_schema().names)) == 96 and gold_schema().names[0] == "date"
    assert len(series_rows()) == 41 and len({r[2] for r in series_rows()}) == 38


def test_panel_picks_newest_version_and_preferred_source(spark):
    t1, t2 = TS(2024, 1, 1), TS(2024, 1, 2)
    p = prices(spark, [
        (D(2024, 1, 3), "^GSPC", 1.0, t1),
        (D(2024, 1, 3), "^GSPC", 2.0, t2),
        (D(2017, 1, 3), "^GSPC", 9.0, t2),
        (D(2024, 1, 3), "AAPL", 9.0, t2),
    ])
    c = crypto(spark, [(D(2024, 1, 3), "BTC-USD", 5.0, t1)])
    m = macro(spark, [
        (D(2024, 1, 3), "CSCICP02JPM460S", 1.0, None), (D(2024, 1, 3), "OECD/MEI_CLI/LOLITOAA.JPN.M", 99.0, None),
        (D(2024, 1, 4), "OECD/MEI_CLI/LOLITOAA.JPN.M", 98.0, None),
    ])
    rows = {(r.series, r.date): r.value for r in gold.curated_panel(p, c, m).collect()}
    assert rows == {
        ("sp500", D(2024, 1, 3)): 2.0, ("bitcoin_price_cc", D(2024, 1, 3)): 5.0,
        ("cc_jp", D(2024, 1, 3)): 1.0, ("cc_jp", D(2024, 1, 4)): 98.0,
    }
    strict = gold.curated_panel(p, c, m, strict_sources=True)
    assert strict.where("series = 'cc_jp'").count() == 1


def small_panel(spark, rows):
    return spark.createDataFrame(rows, "series string, date date, value double")


def test_weekend_macro_value_is_lost_unless_filled_first(spark):
    rows = [("policy_rate_us", D(2024, 6, 1), 5.0), ("sp500", D(2024, 6, 3), 1.0)]  # a Saturday, a Monday
    default = gold.build_gold(small_panel(spark, rows)).collect()
    assert [(r.date, r.policy_rate_us) for r in default] == [(D(2024, 6, 3), None)]
    filled = gold.build_gold(small_panel(spark, rows), gold.GoldOptions(fill_first=True)).collect()
    assert [(r.date, r.policy_rate_us) for r in filled] == [(D(2024, 6, 3), 5.0)]


def test_market_columns_are_not_filled(spark):
    rows = [("sp500", D(2024, 1, 2), 1.0), ("gold", D(2024, 1, 3), 2.0), ("cpi_us", D(2024, 1, 2), 3.0)]
    r = gold.build_gold(small_panel(spark, rows)).where("date = DATE'2024-01-03'").first()
    assert (r.sp500, r.gold, r.cpi_us, r.sp500_ret) == (None, 2.0, 3.0, 0.0)


def long_panel(seed=5, days=420):
    rng = np.random.default_rng(seed)
    dates = [d.date() for d in pd.bdate_range("2022-01-03", periods=days)]
    rows = []
    for i, s in enumerate(["bitcoin_price", "sp500", "bitcoin_price_cc", "policy_rate_us", "cc_us"]):
        v = 50 * (i + 1) * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        if s == "policy_rate_us":
            v = np.repeat([5.0, 5.25], days // 2)
        rows += [(s, d, float(x)) for d, x in zip(dates, v) if rng.random() > 0.1]
    return rows


def as_frame(df):
    return df.orderBy("date").toPandas().set_index("date").astype(float)


def test_wide_table_against_pandas(spark):
    rows = long_panel()
    got = as_frame(gold.build_gold(small_panel(spark, rows)))
    df = pd.DataFrame(rows, columns=["s", "d", "v"]).pivot(index="d", columns="s", values="v").sort_index()
    df[["policy_rate_us", "cc_us"]] = df[["policy_rate_us", "cc_us"]].ffill()
    want = pd.DataFrame(index=df.index)
    for c, p in (("bitcoin_price", "btc"), ("sp500", "sp500")):
        want[f"{p}_ret"] = df[c].ffill().pct_change(fill_method=None)
        want[f"{p}_vol_7d"] = want[f"{p}_ret"].rolling(7, min_periods=2).std()
        want[f"{p}_vol_7d_annualized"] = want[f"{p}_vol_7d"] * 252**0.5
        want[f"{p}_vol_30d"] = want[f"{p}_ret"].rolling(30, min_periods=5).std() * 252**0.5
        want[f"{p}_norm"] = df[c] / df[c].dropna().iloc[0] * 100
    want["corr_btc_sp500_90d"] = want["btc_ret"].rolling(90, min_periods=30).corr(want["sp500_ret"])
    for c in ("policy_rate_us", "cc_us"):
        r = df[c].rolling(252, min_periods=30)
        want[f"{c}_z"] = (df[c] - r.mean()) / r.std()
        want.loc[r.std() == 0, f"{c}_z"] = 0.0
    want["btc_price_diff"] = df["bitcoin_price"] - df["bitcoin_price_cc"]
    want["btc_price_diff_pct"] = want["btc_price_diff"] / df["bitcoin_price"] * 100
    for c in want.columns:
        np.testing.assert_allclose(got[c], want[c], rtol=1e-7, atol=1e-9, err_msg=c)
    assert got["gold_ret"].isna().all()


def observations(spark, rows):
    """Rows (series, date, value[, priority[, version]])."""
    full = [(*r, *(1, TS(2024, 1, 1))[len(r) - 3:]) for r in rows]
    return spark.createDataFrame(full, "series string, date date, value double, priority int, version timestamp")


def filled_and_based(panel):
    """A small derived table: filled values and base-100 prices by date."""
    grid = gold.daily_grid(panel)
    normed = grid.withColumn("norm", base_100("value", by_series()))
    return normed.groupBy("date").agg(*[
        F.max(F.when(F.col("series") == c, F.col(f))).alias(f"{c}_{f}") for c in ("cc_us", "cc_jp", "sp500", "gold") for f in ("value", "norm")
    ])


SMALL = "date date, " + ", ".join(f"{c}_{f} double" for c in ("cc_us", "cc_jp", "sp500", "gold") for f in ("value", "norm"))


def check_appends(spark, tmp_path, batches, compute, schema):
    """One refresh of everything, against a rebuild from the first batch and appends of the others."""
    whole, store = (carry.Store(str(tmp_path / d), schema) for d in ("full", "steps"))
    full = carry.rebuild(spark, whole, observations(spark, sum(batches, [])), compute)
    carry.rebuild(spark, store, observations(spark, batches[0]), compute)
    for batch in batches[1:]:
        out = carry.append(spark, store, observations(spark, batch), compute)
    pd.testing.assert_frame_equal(as_frame(out), as_frame(full), rtol=1e-9)
    for name in ("observed", "carry"):
        a, b = ({tuple(r) for r in x.read(spark, name).collect()} for x in (store, whole))
        assert a == b
    return store


@pytest.fixture(scope="module")
def history():
    """Over two years of weekdays, gaps, and slow series that report on weekends too."""
    rows = long_panel(days=520)
    return rows + [("cc_us", D(2022, 1, 1) + dt.timedelta(days=37 * i), 90.0 + i % 7) for i in range(20)]


@pytest.mark.parametrize("fill_first", [False, True])
def test_late_and_weekend_values_appended_equal_a_refresh(spark, tmp_path, history, fill_first):
    late = [r for r in history if (r[1].weekday() > 4 and r[1].year == 2023) or (r[0] == "sp500" and r[1].month == 5)]
    late += [r for r in history if r[0] == "cc_us" and r[1] < D(2022, 6, 1)]
    rest = [r for r in history if r not in late]
    cut = D(2023, 11, 20)
    batches = [[r for r in rest if r[1] < cut], [r for r in rest if r[1] >= cut], late]
    options = gold.GoldOptions(fill_first=fill_first)
    check_appends(spark, tmp_path, batches, lambda panel: gold.build_gold(panel, options), gold_schema())


def test_appends_out_of_order_over_gaps_and_before_the_start(spark, tmp_path):
    d = [D(2024, 3, 4), D(2024, 3, 5), D(2024, 9, 2), D(2024, 9, 3), D(2023, 1, 2), D(2024, 6, 8), D(2025, 2, 3)]
    batches = [
        [("sp500", d[0], 100.0), ("cc_us", d[0], 1.0)], [("sp500", d[2], 110.0)], [("cc_us", d[5], 2.0)], [("cc_jp", d[4], 7.0)],
        [("gold", d[1], 5.0), ("cc_us", d[1], 3.0)], [], [("gold", d[6], None), ("sp500", d[3], 99.0)], [("gold", d[6], 6.0)],
    ]
    batches.append(batches[1])  # landed twice
    schema = T.StructType.fromDDL(SMALL)
    check_appends(spark, tmp_path, batches, filled_and_based, schema)


def test_preferred_source_newer_version_and_known_value_win_in_any_order(spark, tmp_path):
    day, t = D(2024, 3, 4), [TS(2024, 1, k) for k in range(1, 5)]
    rows = [
        ("cc_jp", day, 1.0, 2, t[3]), ("cc_jp", day, 2.0, 1, t[0]), ("cc_jp", day, 3.0, 1, t[1]), ("cc_jp", day, None, 1, t[2]),
        ("sp500", day, None, 1, t[3]), ("sp500", day, 5.0, 1, t[0]),
    ]
    for order in (rows, rows[::-1]):
        assert {(r.series, r.value) for r in carry.strongest(observations(spark, order)).collect()} == {("cc_jp", 3.0), ("sp500", 5.0)}
    store = check_appends(spark, tmp_path, [rows[2:3], rows[:2] + rows[4:5], rows[3:4] + rows[5:]], filled_and_based, T.StructType.fromDDL(SMALL))
    assert [(r.cc_jp_value, r.sp500_value) for r in store.table(spark).collect()] == [(3.0, 5.0)]


def test_append_reads_only_the_look_back_and_the_carry(spark, tmp_path, history, plan):
    store = carry.Store(str(tmp_path), T.StructType.fromDDL(SMALL))
    carry.rebuild(spark, store, observations(spark, history), filled_and_based)
    start = carry.look_back(spark, store, 202312)
    weekdays = {r[1] for r in history if r[1].weekday() < 5 and r[1] < D(2023, 12, 1)}
    begin = D(start // 100, start % 100, 1)
    later = min(D(m // 100, m % 100, 1) for m in store.months(spark) if m > start)
    assert sum(x >= begin for x in weekdays) >= 252 > sum(x >= later for x in weekdays)
    tail = carry.tail_panel(spark, store, start)
    assert "PartitionFilters: [isnotnull(month#" in plan(tail) and f">= {start})]" in plan(tail) and f"= {start})]" in plan(tail)
    series = {r[0] for r in history}
    assert tail.count() <= sum(r[1] >= begin for r in history) + 4 * len(series)
    assert carry.look_back(spark, store, 202201) == 202201
    assert carry.look_back(spark, store, 202312, rows=10**6) == 202201


def test_empty_store(spark, tmp_path):
    store = carry.Store(str(tmp_path / "s"), T.StructType.fromDDL(SMALL))
    assert carry.append(spark, store, observations(spark, []), filled_and_based).count() == 0
    assert store.months(spark) == []
    out = carry.append(spark, store, observations(spark, [("sp500", D(2024, 3, 4), 1.0), ("sp500", None, 2.0)]), filled_and_based)
    assert [(r.date, r.sp500_value) for r in out.collect()] == [(D(2024, 3, 4), 1.0)]


def write_silver(spark, root, days, close):
    t = TS(2024, 2, 1)
    p = prices(spark, [(d, "^GSPC", close + i, t) for i, d in enumerate(days)])
    p = p.withColumns({"asset_class": F.lit("indices"), "source": F.lit("yfinance"), "load_type": F.lit("daily")})
    sink.write_silver(p, root, "daily")
    m = macro(spark, [(days[0], "DFF", 5.0, None)]).drop("data_source")
    m = m.withColumns({"asset_class": F.lit("economic"), "source": F.lit("fred"), "load_type": F.lit("daily")})
    sink.write_silver(m, root, "daily")


def test_lake_refresh_publish_append(spark, tmp_path):
    root = str(tmp_path)
    days = [D(2024, 1, 2), D(2024, 1, 3), D(2024, 1, 4)]
    write_silver(spark, root, days[:2], 100.0)
    assert gold.run_gold(spark, root, "2024-01-03").count() == 2  # nothing published yet: full refresh
    write_silver(spark, root, days[2:], 110.0)
    want = {
        days[0]: (100.0, 5.0, None), days[1]: (101.0, 5.0, pytest.approx(0.01)),
        days[2]: (110.0, 5.0, pytest.approx(110 / 101 - 1)),
    }
    for _ in range(2):  # published over the table it was read from, twice
        out = gold.run_gold(spark, root, "2024-01-04")
        assert {r.date: (r.sp500, r.policy_rate_us, r.sp500_ret) for r in out.collect()} == want
    appended = {tuple(r) for r in out.collect()}
    assert {tuple(r) for r in gold.run_gold(spark, root).collect()} == appended
    for copy in ("curated/macro_market_merged.csv", "curated/macro_market_merged.parquet"):
        assert {tuple(r) for r in published_rows(spark, root, copy).collect()} == appended
    blanked = published_rows(spark, root, "curated/macro_market_merged.csv", ["policy_rate_us"])
    assert blanked.where("policy_rate_us IS NOT NULL").isEmpty()


def test_payloads_to_wide_table(spark, tmp_path):
    """Landed documents through bronze and silver into the published table."""
    root = str(tmp_path)
    macro_doc = {"series": {"docs": [{"period": ["2024-01-02", "2024-01-04"], "value": [4.0, "NA"]}]}}
    payload = spark.createDataFrame([("BIS/WS_CBPOL/D.XM", json.dumps(macro_doc))], "series_id string, payload string")
    rows = landing.macro_payload_rows(payload).withColumns(
        {"asset_class": F.lit("economic"), "source": F.lit("dbnomics"), "provider": F.lit("bis_data"), "load_type": F.lit("daily")}
    )
    assert sink.write_raw(rows, root, "daily", provider=True) == 1
    bars = [{"time": 1704153600 + 86400 * i, "close": 100.0 + i} for i in range(3)]  # from 2024-01-02
    crypto_doc = {"Response": "Success", "Data": {"Data": bars}}
    payload = spark.createDataFrame([("BTC-USD", json.dumps(crypto_doc))], "ticker string, payload string")
    rows = landing.crypto_payload_rows(payload).withColumns(
        {"asset_class": F.lit("crypto"), "source": F.lit("cryptocompare"), "load_type": F.lit("historical")}
    )
    assert sink.write_raw(rows, root, "historical") == 3
    assert run_silver(spark, root, "cryptocompare", "historical") == 3
    assert run_silver(spark, root, "dbnomics", "daily", "2024-01-02") == 1
    out = gold.run_gold(spark, root).orderBy("date").collect()
    assert [(r.date, r.bitcoin_price_cc, r.ecb_main_rate) for r in out] == [
        (D(2024, 1, 2), 100.0, 4.0), (D(2024, 1, 3), 101.0, 4.0), (D(2024, 1, 4), 102.0, 4.0),
    ]
    assert out[1].btc_cc_ret == pytest.approx(0.01) and out[2].btc_cc_norm == pytest.approx(102.0)
