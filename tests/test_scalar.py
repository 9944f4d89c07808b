import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalar
from tideline.operators import cleanse

D = dt.date


def values(spark, inputs, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {dtype}")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_parse_period(spark):
    inputs = ["2020", "2020-03", "2020-Q2", "2020Q4", " 2020-03-05 ", "2020-W05", "2020-S1", "2020-Q5", "bad", "", None]
    assert values(spark, inputs, scalar.parse_period) == [
        D(2020, 1, 1), D(2020, 3, 1), D(2020, 4, 1), D(2020, 10, 1), D(2020, 3, 5),
        None, None, None, None, None, None,
    ]


def test_strict_date_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        values(spark, ["bad"], scalar.parse_date)


def test_parse_number(spark):
    inputs = ["1.5", " 2 ", "1e3", "-.5", "NaN", "n/a", "1.5d", "2f", "", None]
    assert values(spark, inputs, scalar.parse_number) == [1.5, 2.0, 1000.0, -0.5] + [None] * 6


def test_cleanse_number(spark):
    inputs = ["1,234.5", " NA ", ".", "", "  ", "None", "null", "N/A", "nan", "7", "x"]
    assert values(spark, inputs, scalar.cleanse_number) == [1234.5] + [None] * 8 + [7.0, None]


def test_nan_to_null(spark):
    assert values(spark, [1.0, math.nan, None, math.inf], scalar.nan_to_null, "double") == [1.0, None, None, math.inf]


def test_unix_date_ignores_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, [0, 86399, 86400, -1], scalar.unix_date, "bigint") == [
            D(1970, 1, 1), D(1970, 1, 1), D(1970, 1, 2), D(1969, 12, 31),
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_weekday_and_pair(spark):
    days = ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08"]
    assert values(spark, days, lambda c: scalar.is_weekday(c.cast("date"))) == [True, False, False, True]
    assert values(spark, ["BTC-USD", "ETH"], scalar.pair_symbol) == ["BTC", "ETH"]


def test_series_id_parts(spark):
    df = spark.createDataFrame([("A/B/C/D",), ("A/B",), ("A",)], "id string")
    rows = df.select(*[c.alias(n) for n, c in scalar.series_id_parts("id").items()]).collect()
    assert [tuple(r) for r in rows] == [("A", "B", "C/D"), ("A", "B", ""), ("A", None, "")]


@pytest.mark.parametrize(
    ("symbol", "valid"),
    [
        ("AAPL", True), ("aapl", True), ("BRK.A", True), ("BF.B", True), ("GOOGL", True),
        ("ABCDEF", False), ("AB-WS", False), ("A-UX", False), ("A-R", False), ("A^B", False),
        ("A+", False), ("~T", False), ("A-P", False), ("A-PB", False), ("A-PBC", True),
        ("X-P-Q", True), ("A1", False), ("BRK.1", False),
    ],
)
def test_ticker_validity(spark, symbol, valid):
    assert values(spark, [symbol], scalar.is_valid_ticker) == [valid]


def test_safe_divide(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r.q for r in df.select(scalar.safe_divide("a", "b").alias("q")).collect()] == [None, 0.5, None]


BAR = "date timestamp_ntz, open double, high double, low double, close double, adj_close double, volume bigint, ticker string, fetch_timestamp string"


def test_silver_prices(spark):
    at = dt.datetime(2019, 1, 2)
    rows = [
        (at, 1.00005, 2.0, 1.0, 1.5, 1.23456, 7, "OK", "t"),
        (at, 1.0, 2.0, 1.0, None, 1.0, 7, "NULL", "t"),
        (at, 1.0, 2.0, 1.0, math.nan, 1.0, 7, "NAN", "t"),
        (at, 1.0, 2.0, 1.0, 0.0, 1.0, 7, "ZERO", "t"),
        (at, 1.0, 1.0, 2.0, 1.0, 1.0, 7, "CROSSED", "t"),
        (at, 1.0, None, 2.0, 1.0, 1.0, 7, "UNKNOWN", "t"),
        (dt.datetime(2017, 12, 31), 1.0, 2.0, 1.0, 1.5, 1.0, 7, "OLD", "t"),
    ]
    bronze = spark.createDataFrame(rows, BAR)
    out = cleanse.silver_prices(bronze, "stocks", "historical", "2018-01-01").collect()
    assert [(r.ticker, r.open, r.adjusted_close, r.date, r.year, r.month, r.day) for r in out] == [
        ("OK", 1.0001, 1.2346, D(2019, 1, 2), 2019, 1, 2)
    ]
    assert cleanse.silver_prices(bronze, "stocks", "daily").count() == 2


def test_silver_crypto_keeps_bad_rows_and_renames(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "BTC", -1.0, 2.0, 3.0)],
        "date date, symbol string, close double, volume_from double, volume_to double",
    )
    row = cleanse.silver_crypto(df, "crypto", "daily").first()
    assert (row.ticker, row.close, row.volume, row.volume_coin, row.open) == ("BTC", -1.0, 3.0, 2.0, None)


def test_ticker_column_wins_over_symbol(spark):
    df = spark.createDataFrame([("BTC", "BTC-USD", 1.0)], "symbol string, ticker string, close double")
    row = cleanse.silver_crypto(df, "crypto", "daily", "2024-01-05").first()
    assert (row.ticker, row.date) == ("BTC-USD", D(2024, 1, 5))


def test_csv_cleanse_blanks_named_columns(spark):
    df = spark.createDataFrame([("2024-01-02", "1,000", "5")], "DATE string, GDP string, Claims string")
    row = cleanse.cleanse_csv(df, null_columns=["claims"]).first()
    assert row.asDict() == {"date": D(2024, 1, 2), "gdp": 1000.0, "claims": None}


def test_drop_empty_bars_and_names(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, 1), (None, 1.0, None, None, 2)],
        "Open double, High double, Low double, Close double, `Adj Close` int",
    )
    out = cleanse.drop_empty_bars(cleanse.snake_names(df))
    assert [r.adj_close for r in out.collect()] == [2]
