"""Layer schemas and the fixed business values of the wide table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_D, _S, _L, _I = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType()
_DATE, _TS, _NTZ = T.DateType(), T.TimestampType(), T.TimestampNTZType()

BRONZE_PRICES = _struct(
    ("date", _NTZ), ("open", _D), ("high", _D), ("low", _D), ("close", _D),
    ("adj_close", _D), ("volume", _L), ("ticker", _S), ("fetch_timestamp", _S),
)

BRONZE_CRYPTO = _struct(
    ("date", _NTZ), ("symbol", _S), ("tsym", _S), ("open", _D), ("high", _D),
    ("low", _D), ("close", _D), ("volume_from", _D), ("volume_to", _D),
    ("fetch_timestamp", _S), ("ticker", _S),
)

BRONZE_MACRO = _struct(
    ("date", _NTZ), ("value", _D), ("series_id", _S), ("provider", _S),
    ("dataset", _S), ("series_code", _S), ("series_name", _S), ("unit", _S),
    ("frequency", _S), ("source", _S), ("fetch_timestamp", _S),
)

SILVER_PRICES = _struct(
    ("date", _DATE), ("ticker", _S), ("asset_class", _S), ("source", _S),
    ("load_type", _S), ("open", _D), ("high", _D), ("low", _D), ("close", _D),
    ("adjusted_close", _D), ("volume", _L), ("year", _I), ("month", _I),
    ("day", _I), ("fetch_timestamp", _S), ("transform_timestamp", _TS),
)

SILVER_CRYPTO = _struct(
    ("date", _DATE), ("ticker", _S), ("open", _D), ("high", _D), ("low", _D),
    ("close", _D), ("volume", _D), ("volume_coin", _D), ("asset_class", _S),
    ("source", _S), ("load_type", _S), ("year", _I), ("month", _I), ("day", _I),
    ("fetch_timestamp", _S), ("transform_timestamp", _TS),
)

SILVER_MACRO = _struct(
    ("date", _DATE), ("indicator", _S), ("value", _D), ("asset_class", _S),
    ("source", _S), ("provider", _S), ("load_type", _S), ("year", _I),
    ("month", _I), ("day", _I), ("fetch_timestamp", _S),
    ("transform_timestamp", _TS),
)

LOAD_STATE = _struct(
    ("asset_class", _S), ("source", _S), ("last_update_date", _DATE),
    ("status", _S), ("records_fetched", _L), ("last_run_timestamp", _S),
)

# Landed JSON documents.
MACRO_PAYLOAD = T.StructType([
    T.StructField("series", T.StructType([
        T.StructField("docs", T.ArrayType(_struct(
            ("period", T.ArrayType(_S)), ("value", T.ArrayType(_S)),
            ("series_name", _S), ("unit", _S), ("@unit", _S),
            ("frequency", _S), ("@frequency", _S),
        ))),
    ])),
])

CRYPTO_PAYLOAD = T.StructType([
    T.StructField("Response", _S),
    T.StructField("Message", _S),
    T.StructField("Data", T.StructType([
        T.StructField("Data", T.ArrayType(_struct(
            ("time", _L), ("open", _D), ("high", _D), ("low", _D), ("close", _D),
            ("volumefrom", _D), ("volumeto", _D),
        ))),
    ])),
])

COIN_MARKET = _struct(
    ("id", _S), ("symbol", _S), ("name", _S), ("market_cap", _D),
    ("market_cap_rank", _I), ("total_volume", _D), ("current_price", _D),
    ("last_updated", _S),
)

STATE_DOCUMENT = T.StructType([
    T.StructField("last_run_timestamp", _S),
    T.StructField("sources", T.MapType(_S, T.MapType(_S, _struct(
        ("last_update_date", _S), ("status", _S), ("records_fetched", _L),
        ("last_run_timestamp", _S),
    )))),
])

# ---------------------------------------------------------------------------
# Series identifiers and the warehouse columns they feed.
# ---------------------------------------------------------------------------
HISTORY_FLOOR = "2018-01-01"
FETCH_FLOOR = "1980-01-01"
DEFAULT_STATE_DATE = "2025-11-30"

ASSET_CLASSES = ["stocks", "indices", "bonds", "crypto", "commodities", "currencies"]

YFINANCE_SERIES = {
    "^GSPC": "sp500",
    "^IXIC": "nasdaq",
    "BTC-USD": "bitcoin_price",
    "ETH-USD": "ethereum_price",
    "CL=F": "oil",
    "GC=F": "gold",
    "HG=F": "copper",
    "USDCHF=X": "usdchf",
    "EURUSD=X": "eurusd",
    "GBPUSD=X": "gbpusd",
    "USDJPY=X": "usdjpy",
}

CRYPTOCOMPARE_SERIES = {
    "BTC-USD": "bitcoin_price_cc",
    "ETH-USD": "ethereum_price_cc",
}

FRED_SERIES = {
    "DFF": "policy_rate_us",
    "DGS10": "treasury_10y",
    "DGS2": "treasury_2y",
    "T10Y2Y": "treasury_spread",
    "DPRIME": "prime_rate",
    "CPIAUCSL": "cpi_us",
    "GDP": "gdp_us",
    "M2SL": "m2_us",
    "ICSA": "jobless_claims",
    "WALCL": "fed_balance_sheet",
    "CHECPIALLMINMEI": "cpi_ch",
    "GBRCPIALLMINMEI": "cpi_uk",
    "JPNCPIALLMINMEI": "cpi_jp",
    "CP0000EZ19M086NEST": "cpi_eu",
    "CLVMNACSCAB1GQEA19": "gdp_eu",
    "CSCICP02EZM460S": "cc_eu",
    "CSCICP02GBM460S": "cc_uk",
    "CSCICP02JPM460S": "cc_jp",
    "CSCICP02DEM460S": "cc_de",
    "CSCICP02CHQ460S": "cc_ch",
    "CSINFT02USM460S": "cc_us",
}

DBNOMICS_SERIES = {
    "BIS/WS_CBPOL/D.XM": "ecb_main_rate",
    "BIS/WS_CBPOL/D.GB": "policy_rate_uk",
    "BIS/WS_CBPOL/D.CH": "policy_rate_ch",
    "BIS/WS_CBPOL/D.JP": "policy_rate_jp",
    "OECD/MEI_CLI/LOLITOAA.JPN.M": "cc_jp",
    "OECD/MEI_CLI/LOLITOAA.GBR.M": "cc_uk",
    "OECD/MEI_CLI/LOLITOAA.DEU.M": "cc_eu",
}

MARKET_COLUMNS = [
    "sp500", "nasdaq", "bitcoin_price", "ethereum_price", "bitcoin_price_cc",
    "ethereum_price_cc", "oil", "gold", "copper", "usdchf", "eurusd", "gbpusd",
    "usdjpy",
]

MACRO_COLUMNS = [
    "policy_rate_us", "cpi_us", "gdp_us", "m2_us", "treasury_10y", "treasury_2y",
    "treasury_spread", "prime_rate", "jobless_claims", "fed_balance_sheet",
    "cpi_ch", "cpi_uk", "cpi_jp", "cpi_eu", "gdp_eu", "ecb_main_rate",
    "policy_rate_uk", "policy_rate_ch", "policy_rate_jp", "cc_us", "cc_jp",
    "cc_uk", "cc_eu", "cc_de", "cc_ch",
]

BASE_COLUMNS = MARKET_COLUMNS + MACRO_COLUMNS

# price column -> prefix of its derived columns
METRIC_PREFIX = {
    "bitcoin_price": "btc",
    "ethereum_price": "eth",
    "bitcoin_price_cc": "btc_cc",
    "ethereum_price_cc": "eth_cc",
    "sp500": "sp500",
    "nasdaq": "nasdaq",
    "gold": "gold",
    "copper": "copper",
    "oil": "oil",
}
VOL_7D = ["btc", "eth", "sp500", "nasdaq", "gold", "copper", "oil"]
VOL_30D = ["btc", "eth", "sp500", "gold", "copper", "oil"]
ZSCORE_COLUMNS = [
    "policy_rate_us", "treasury_10y", "treasury_2y", "prime_rate",
    "ecb_main_rate", "policy_rate_uk", "policy_rate_ch", "policy_rate_jp",
    "cc_us", "cc_jp", "cc_uk", "cc_eu", "cc_de", "cc_ch",
]
CORRELATION_PAIRS = {"corr_btc_sp500_90d": ("bitcoin_price", "sp500")}
PRICE_GAPS = {
    "btc": ("bitcoin_price", "bitcoin_price_cc"),
    "eth": ("ethereum_price", "ethereum_price_cc"),
}

# (rows in frame, minimum non-null rows)
FRAME_VOL_SHORT = (7, 2)
FRAME_VOL_LONG = (30, 5)
FRAME_CORRELATION = (90, 30)
FRAME_ZSCORE = (252, 30)
TRADING_DAYS = 252

EXCLUDED_COINS = [
    "USDT", "USDC", "DAI", "BUSD", "TUSD", "USDP", "USDD", "GUSD", "FRAX",
    "WBTC", "WETH", "STETH", "WSTETH", "RETH", "CBETH", "WBETH", "HBTC",
    "RENBTC", "SBTC",
]

INVALID_SYMBOL_PARTS = ["-WS", "-WT", "-UN", "-U", "-R", "-RT", "^", "+", "~"]
DIGIT_SYMBOL_EXCEPTIONS = ["BRK.A", "BRK.B", "BF.A", "BF.B"]
EXCHANGE_ORDER = {"NASDAQ": 1, "NYSE": 2, "AMEX": 3}
MIN_DOLLAR_VOLUME = 1_000_000
MIN_COIN_VOLUME = 1_000_000
DOLLAR_VOLUME_TIERS = [
    ("$100M+", 100_000_000, None),
    ("$10M-$100M", 10_000_000, 100_000_000),
    ("$1M-$10M", 1_000_000, 10_000_000),
]
# ---------------------------------------------------------------------------


def derived_columns() -> list[str]:
    """The 57 derived columns in creation order."""
    names = [f"{p}_ret" for p in METRIC_PREFIX.values()]
    for p in VOL_7D:
        names += [f"{p}_vol_7d", f"{p}_vol_7d_annualized"]
    names += [f"{p}_vol_30d" for p in VOL_30D]
    names += list(CORRELATION_PAIRS)
    names += [f"{p}_norm" for p in METRIC_PREFIX.values()]
    names += [f"{c}_z" for c in ZSCORE_COLUMNS]
    for p in PRICE_GAPS:
        names += [f"{p}_price_diff", f"{p}_price_diff_pct"]
    return names


def gold_schema() -> T.StructType:
    """``date`` plus 38 base and 57 derived doubles: the 96 warehouse columns."""
    columns = [(name, _D) for name in BASE_COLUMNS + derived_columns()]
    return _struct(("date", _DATE), *columns)


SERIES_DIM = _struct(("source", _S), ("series_id", _S), ("series", _S), ("priority", _I))


def series_rows() -> list[tuple[str, str, str, int]]:
    """(source, series_id, series, priority) of every curated input.

    Two sources may feed one column; the lower priority number wins there.
    """
    rows = [("yfinance", k, v, 1) for k, v in YFINANCE_SERIES.items()]
    rows += [("cryptocompare", k, v, 1) for k, v in CRYPTOCOMPARE_SERIES.items()]
    rows += [("fred", k, v, 1) for k, v in FRED_SERIES.items()]
    rows += [("dbnomics", k, v, 2) for k, v in DBNOMICS_SERIES.items()]
    return rows


def inline_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A few literal rows as a plan whose small size the optimizer can see.

    ``createDataFrame`` on a Python list hides its size, and a join would then
    treat the literal side as the large one.
    """
    struct = schema if isinstance(schema, str) else ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in schema.fields
    )
    names = [f.split()[0] for f in struct.split(",")]
    literal = json.dumps([dict(zip(names, row)) for row in rows])
    parsed = F.from_json(F.lit(literal), "array<struct<" + struct + ">>")
    return spark.range(0, 1, 1, 1).select(F.inline(parsed))


def series_dimension(spark: SparkSession) -> DataFrame:
    """The fixed mapping as a 41-row dimension."""
    return inline_rows(spark, series_rows(), SERIES_DIM)


def conform_landed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """As :func:`conform` for files of other tools: NaN is unknown, and what does not fit its type is NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    known = df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in floats})
    present = set(known.columns)
    return known.selectExpr(*[
        f"TRY_CAST({f'`{f.name}`' if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields
    ])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: absent columns become typed NULLs."""
    present = set(df.columns)
    return df.selectExpr(*[
        f"CAST({f'`{f.name}`' if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields
    ])
