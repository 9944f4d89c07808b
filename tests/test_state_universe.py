import datetime as dt
import json

import pytest

from tideline.operators import state, universe
from tideline.schemas import LOAD_STATE
from tideline.sources import landing
from tideline.sources import universe as documents

D = dt.date


def known(spark, last):
    return spark.createDataFrame([("stocks", "yfinance", last, "success", 5, "t")], LOAD_STATE)


def windows(spark, last, today, **kw):
    plan = spark.createDataFrame([("stocks", "yfinance")], "asset_class string, source string")
    return [(r.start_date, r.end_date) for r in state.load_windows(plan, known(spark, last), today, **kw).collect()]


@pytest.mark.parametrize(
    ("today", "trading", "end"),
    [
        ("2024-01-05", True, D(2024, 1, 4)),
        ("2024-01-06", True, D(2024, 1, 5)),
        ("2024-01-07", True, D(2024, 1, 5)),  # Sunday: yesterday is Saturday
        ("2024-01-08", True, D(2024, 1, 5)),  # Monday: yesterday is Sunday
        ("2024-01-08", False, D(2024, 1, 7)),
    ],
)
def test_window_end(spark, today, trading, end):
    assert windows(spark, D(2024, 1, 1), today, trading_days_only=trading) == [(D(2024, 1, 2), end)]


def test_up_to_date_source_has_no_window(spark):
    assert windows(spark, D(2024, 1, 5), "2024-01-08") == []


def test_window_is_capped_and_looks_back(spark):
    got = windows(spark, D(2024, 1, 1), "2024-02-01", target_end=D(2024, 1, 10), lookback_days=3)
    assert got == [(D(2023, 12, 30), D(2024, 1, 10))]


def test_missing_state_uses_default(spark):
    plan = spark.createDataFrame([("bonds", "fred")], "asset_class string, source string")
    out = state.load_windows(plan, known(spark, D(2024, 1, 1)), "2025-12-05").first()
    assert (out.start_date, out.end_date) == (D(2025, 12, 1), D(2025, 12, 4))


def test_advance_state(spark):
    outcomes = spark.createDataFrame(
        [("stocks", "yfinance", "failed", D(2024, 1, 9), 7, "now"), ("bonds", "fred", "success", D(2024, 1, 9), 3, "now")],
        "asset_class string, source string, status string, end_date date, records bigint, run_timestamp string",
    )
    first = state.advance_state(known(spark, D(2024, 1, 1)), outcomes)
    want = {
        ("stocks", "yfinance", D(2024, 1, 1), "failed", 0, "now"),
        ("bonds", "fred", D(2024, 1, 9), "success", 3, "now"),
    }
    assert {tuple(r) for r in first.collect()} == want
    assert {tuple(r) for r in state.advance_state(first, outcomes).collect()} == want
    summary = {r.status: (r.sources, r.total_records) for r in state.run_summary(outcomes).collect()}
    assert summary == {"failed": (1, 7), "success": (1, 3)}


def test_state_document_round_trip(spark):
    doc = {
        "last_run_timestamp": "x",
        "sources": {
            "economic": {"fred": {"last_update_date": "2025-12-22", "status": "success", "records_fetched": 27, "last_run_timestamp": "a"}},
            "bonds": {"fred": {"last_update_date": "2025-12-22", "status": "success", "records_fetched": 0, "last_run_timestamp": "b"}},
        },
    }
    rows = state.parse_state_document(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    assert {(r.asset_class, r.source, r.last_update_date, r.records_fetched) for r in rows.collect()} == {
        ("economic", "fred", D(2025, 12, 22), 27), ("bonds", "fred", D(2025, 12, 22), 0),
    }
    written = json.loads(state.state_document(rows, "x").first().value)
    assert written == doc


@pytest.mark.parametrize(
    ("selector", "count"), [("all", 9), ("yahoo", 6), ("yfinance", 6), ("crypto", 2), ("fred", 1), ("DBNOMICS", 1)]
)
def test_run_plan(spark, selector, count):
    assert state.run_plan(spark, selector).count() == count


def test_unknown_selector_is_an_error(spark):
    with pytest.raises(ValueError):
        state.run_plan(spark, "nothing")


def test_sources_without_series_are_skipped(spark):
    plan = spark.createDataFrame([("a", ["x"]), ("b", [])], "source string, series array<string>")
    assert [r.source for r in state.with_series(plan).collect()] == ["a"]


def test_listed_symbols(spark):
    rows = spark.createDataFrame(
        [(" AAA ", "one", "nasdaq"), ("AAA", "two", "nyse"), ("AAA-WS", "w", "nyse"), ("", "none", "amex"), ("B", "b1", "amex"), ("B", "b2", "amex")],
        "symbol string, name string, exchange string",
    )
    assert {tuple(r) for r in universe.listed_symbols(rows).collect()} == {("AAA", "two", "NYSE"), ("B", "b2", "AMEX")}


def test_dollar_volume_universe(spark):
    weekly = spark.createDataFrame(
        [("A", D(2024, 1, 1), 10.0, 1_000_003.0), ("A", D(2024, 1, 8), None, None), ("Z", D(2024, 1, 1), 0.0, 5.0), ("L", D(2024, 1, 1), 1.0, 10.0)],
        "symbol string, date date, close double, volume double",
    )
    volumes = universe.dollar_volumes(universe.last_quotes(weekly))
    assert {tuple(r) for r in volumes.collect()} == {("A", 10.0, 200000, 2000006.0), ("L", 1.0, 2, 2.0)}
    symbols = spark.createDataFrame([("A", "a", "NYSE"), ("L", "l", "NYSE")], "symbol string, name string, exchange string")
    stocks = universe.liquid_universe(symbols, volumes)
    assert [r.symbol for r in stocks.collect()] == ["A"]
    assert {r.tier: r.stocks for r in universe.count_by_tier(stocks).collect()} == {"$100M+": 0, "$10M-$100M": 0, "$1M-$10M": 1}
    assert [r.symbol for r in universe.top_symbols(stocks, 1).collect()] == ["A"]


def test_coin_universe(spark):
    rows = spark.createDataFrame(
        [("btc-id", "btc", "Bitcoin", 5e6), ("usdt-id", "usdt", "Tether", 9e9), ("low", "low", "Low", 9e5), ("nul", "nul", "Null", None)],
        "id string, symbol string, name string, total_volume double",
    )
    from tideline.schemas import COIN_MARKET, conform

    coins = universe.coin_universe(conform(rows, COIN_MARKET)).collect()
    assert [(c.coingecko_id, c.symbol, c.yahoo_symbol, c.total_volume_24h) for c in coins] == [("btc-id", "BTC", "BTC-USD", 5e6)]


def test_configuration_documents(spark, tmp_path):
    doc = {
        "stocks": [{"symbol": "A"}, {"symbol": "A"}],
        "assets": [{"yahoo_finance": "TLT", "fred": None}, {"yahoo_finance": None, "fred": "DGS1"}],
        "simplified_lists": {"fred_all": ["DFF", "GDP"]},
        "dbnomics_exclusive": {
            "_note": "text", "bis_data": {"series": [{"id": "BIS/X/Y"}]}, "empty": {"series": []}, "bare": {},
        },
    }
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=2))
    df = documents.read_documents(spark, str(tmp_path / "doc.json"))
    ids = lambda d: {r.series_id for r in d.collect()}
    assert ids(documents.listed_ids(df, "stocks", "symbol")) == {"A"}
    assert ids(documents.listed_ids(df, "assets", "yahoo_finance")) == {"TLT"}
    assert ids(documents.listed_ids(df, "assets", "fred")) == {"DGS1"}
    assert ids(documents.flat_list_ids(df, "simplified_lists", "fred_all")) == {"DFF", "GDP"}
    assert {tuple(r) for r in documents.grouped_ids(df, "dbnomics_exclusive").collect()} == {("bis_data", "BIS/X/Y")}


def test_macro_payload(spark):
    doc = lambda **kw: json.dumps({"series": {"docs": [kw]}})
    rows = [
        ("P/D/A/B", doc(period=["2020", "2020-02", "bad", "2020-Q2"], value=[1, "NA", 3, 4.5], series_name="n", unit="u", **{"@unit": "at"})),
        ("P/D", doc(period=["2020"], value=[1])),
        ("P/D/empty", doc(period=[], value=[])),
        ("P/D/none", json.dumps({"series": {"docs": []}})),
        ("P/D/odd", doc(period=["2020", "2021"], value=[1])),
        ("P/D/broken", "{"),
    ]
    out = landing.macro_payload_rows(spark.createDataFrame(rows, "series_id string, payload string"))
    assert {(r.series_id, r.date, r.value, r.provider, r.dataset, r.series_code, r.unit, r.frequency) for r in out.collect()} == {
        ("P/D/A/B", D(2020, 1, 1), 1.0, "P", "D", "A/B", "at", ""),
        ("P/D/A/B", D(2020, 4, 1), 4.5, "P", "D", "A/B", "at", ""),
    }


def test_crypto_payload(spark):
    bars = [{"time": 86400 * i, "open": 1, "high": 2, "low": 0.5, "close": 1.5, "volumefrom": 3, "volumeto": 4} for i in range(3)]
    rows = [
        ("BTC-USD", json.dumps({"Response": "Success", "Data": {"Data": bars}})),
        ("ETH-USD", json.dumps({"Response": "Error", "Message": "no", "Data": {"Data": bars}})),
    ]
    out = landing.crypto_payload_rows(spark.createDataFrame(rows, "ticker string, payload string"), start="1970-01-02", end="1970-01-02")
    r = out.first()
    assert out.count() == 1
    assert (r.date, r.symbol, r.tsym, r.close, r.volume_from) == (D(1970, 1, 2), "BTC", "USD", 1.5, 3.0)


def test_landed_universe_files(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    first = [{"id": "a", "symbol": "aa", "total_volume": 2e6}, {"id": "b", "symbol": "bb"}]
    second = [{"id": "c", "symbol": "cc", "total_volume": 3000000}]
    for i, coins in enumerate((first, second)):
        (pages / f"{i}.json").write_text(json.dumps(coins, indent=1))
    coins = universe.coin_universe(documents.read_coin_pages(spark, str(pages)))
    assert sorted(r.symbol for r in coins.collect()) == ["AA", "CC"]
    paths = {}
    for exchange, rows in (("nasdaq", [{"symbol": " X ", "name": "old"}]), ("amex", [{"symbol": "X", "name": " new "}])):
        (tmp_path / f"{exchange}.json").write_text(json.dumps(rows))
        paths[exchange] = str(tmp_path / f"{exchange}.json")
    listed = universe.listed_symbols(documents.read_listings(spark, paths))
    assert [tuple(r) for r in listed.collect()] == [("X", "new", "AMEX")]


def test_pages_until_the_first_below_the_threshold(spark, tmp_path):
    def land(page, *coins):
        folder = tmp_path / f"page={page}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{len(list(folder.iterdir()))}.txt").write_text(json.dumps([{"id": i, "total_volume": v} for i, v in coins]))

    def kept():
        rows = documents.until_below(documents.coin_pages(spark, str(tmp_path)), 100.0).collect()
        return sorted((r.page, r.id, r.total_volume) for r in rows)

    land(1, ("a", 900.0), ("b", 800.0))
    land(2, ("c", 700.0))
    land(10, ("d", 100.0))
    assert kept() == [(1, "a", 900.0), (1, "b", 800.0), (2, "c", 700.0), (10, "d", 100.0)]  # no page is below
    land(3, ("e", 300.0), ("f", 99.0))
    land(3, ("g", 250.0))  # the rest of the same page
    assert kept() == [(1, "a", 900.0), (1, "b", 800.0), (2, "c", 700.0), (3, "e", 300.0), (3, "f", 99.0), (3, "g", 250.0)]
    land(2, ("h", None))  # an unknown volume is below
    assert [r[1] for r in kept()] == ["a", "b", "c", "h"]
    land(1)  # an empty page
    assert [r[1] for r in kept()] == ["a", "b"]


def test_group_selection_and_outcomes(spark):
    groups = spark.createDataFrame([("BIS", 3), ("oecd", 2), ("None", 0), ("Lost", 1)], "group string, series_count int")
    results = spark.createDataFrame([("BIS", "success", 30), ("oecd", "failed", 9), ("None", "success", 5)], "group string, status string, records long")
    rows = lambda s: {tuple(r) for r in state.group_outcomes(state.select_groups(groups, s), results, "e/").collect()}
    assert rows("all") == {("e/BIS", "success", 30), ("e/oecd", "failed", 0), ("e/None", "skipped", 0), ("e/Lost", "failed", 0)}
    assert rows("bis") == {("e/BIS", "success", 30), ("e/oecd", "skipped", 0), ("e/None", "skipped", 0), ("e/Lost", "skipped", 0)}
    assert {r[1] for r in rows("nothing")} == {"skipped"}
    summary = state.named_summary(state.group_outcomes(state.select_groups(groups), results, "e/"))
    assert {tuple(r) for r in summary.collect()} == {
        ("success", 1, "e/BIS", 30), ("failed", 2, "e/Lost, e/oecd", 0), ("skipped", 1, "e/None", 0)
    }
