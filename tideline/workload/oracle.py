"""ANSI SQL that each registered query must equal, over the same whole tables."""

from __future__ import annotations

from tideline.schemas import (
    BASE_COLUMNS,
    CORRELATION_PAIRS,
    CRYPTOCOMPARE_SERIES,
    DBNOMICS_SERIES,
    EXCLUDED_COINS,
    FRED_SERIES,
    MACRO_COLUMNS,
    METRIC_PREFIX,
    PRICE_GAPS,
    VOL_7D,
    VOL_30D,
    YFINANCE_SERIES,
    ZSCORE_COLUMNS,
    gold_schema,
)
from tideline.workload.queries import (
    ALL_PRIORITIES,
    COIN_SYMBOLS,
    EVENT_CLASSES,
    GOLD_FLOOR,
    GOLD_TICKERS,
    PRIORITY_MAP,
    SYMBOL_ENDINGS,
)

ORACLE: dict[str, str] = {}

EVENT_BARS = """bars AS (
  SELECT event_type AS series, CAST(ts AS DATE) AS date,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2)"""

ORDER_PANEL = """panel AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,
         arg_max(o_totalprice, o_orderkey) AS value
  FROM orders GROUP BY 1, 2)"""

MACRO_ROWS = """macro AS (
  SELECT l_returnflag AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         avg(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""

WEEKDAY = "isodow(date) <= 5"

DENSE_ORDERS = f"""{ORDER_PANEL},
wp AS (SELECT * FROM panel WHERE {WEEKDAY}),
dense AS (
  SELECT s.series, c.date, wp.value
  FROM (SELECT DISTINCT series FROM wp) s CROSS JOIN (SELECT DISTINCT date FROM wp) c
  LEFT JOIN wp ON wp.series = s.series AND wp.date = c.date)"""

W = "PARTITION BY series ORDER BY date"
SO_FAR = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def trailing(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RETURNS = f"""padded AS (
  SELECT *, last_value(value IGNORE NULLS) OVER {SO_FAR} AS filled FROM dense),
rets AS (
  SELECT series, date, value,
         filled / nullif(lag(filled) OVER ({W}), 0) - 1.0 AS ret
  FROM padded)"""

SQRT = "sqrt(252.0::DOUBLE)"


def std(col: str, n: int, least: int) -> str:
    w = trailing(n)
    return f"CASE WHEN count({col}) OVER {w} >= {least} THEN stddev_samp({col}) OVER {w} END"


def zscore(col: str = "value") -> str:
    w = trailing(252)
    return (
        f"CASE WHEN count({col}) OVER {w} < 30 THEN NULL"
        f" WHEN min({col}) OVER {w} = max({col}) OVER {w} THEN 0.0"
        f" ELSE ({col} - avg({col}) OVER {w}) / nullif(stddev_samp({col}) OVER {w}, 0) END"
    )


def r(expr: str, digits: int) -> str:
    return f"round({expr}, {digits}) + 0.0"


VOLS = f"""vols AS (
  SELECT series, date, value, ret, {std('ret', 7, 2)} AS vol_7d,
         ({std('ret', 30, 5)}) * {SQRT} AS vol_30d
  FROM rets)"""

# -- cleaning ---------------------------------------------------------------------

ORACLE["silver_quality_filter"] = """
WITH b AS (
  SELECT ts, user_id, event_type, value / 3.0 AS open,
    CASE WHEN event_id % 83 = 0 THEN value / 4.0 WHEN event_id % 79 = 0 THEN NULL ELSE value END AS high,
    value / 3.5 AS low,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 0.0
         WHEN event_id % 73 = 0 THEN NULL ELSE value / 3.1 END AS close,
    value / 3.3 AS adj_close
  FROM events)
SELECT CAST(ts AS DATE) AS date, event_type AS ticker, 'crypto' AS asset_class, 'yfinance' AS source,
  'daily' AS load_type, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low,
  round(close, 4) AS close, round(adj_close, 4) AS adjusted_close, user_id * 10 AS volume,
  CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
  '2024-02-01T00:00:00' AS fetch_timestamp
FROM b WHERE close IS NOT NULL AND close > 0 AND high >= low"""

ORACLE["macro_conform"] = f"""
WITH {MACRO_ROWS}
SELECT date, series AS indicator, value, 'economic' AS asset_class, 'fred' AS source,
  CAST(NULL AS VARCHAR) AS provider, 'historical' AS load_type, CAST(year(date) AS INTEGER) AS year,
  CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
  CAST(NULL AS VARCHAR) AS fetch_timestamp
FROM macro WHERE month(date) NOT IN (6, 9)"""

ORACLE["crypto_conform"] = f"""
WITH {EVENT_BARS}
SELECT date, series AS ticker, open, high, low, close, volume * close AS volume,
  CAST(volume AS DOUBLE) AS volume_coin, 'crypto' AS asset_class, 'cryptocompare' AS source,
  'historical' AS load_type, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  CAST(day(date) AS INTEGER) AS day, CAST(NULL AS VARCHAR) AS fetch_timestamp
FROM bars"""

ORACLE["history_floor"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders
WHERE o_orderdate >= DATE '1998-01-01'"""

ORACLE["date_range_clip"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-09-30'"""

ORACLE["ohlc_all_null_drop"] = """
SELECT * FROM (
  SELECT event_id, CASE WHEN event_id % 2 <> 0 THEN value END AS open,
    CASE WHEN event_id % 3 <> 0 THEN value END AS high,
    CASE WHEN event_id % 5 <> 0 THEN value END AS low,
    CASE WHEN event_id % 7 <> 0 THEN value END AS close
  FROM events)
WHERE coalesce(open, high, low, close) IS NOT NULL"""

ORACLE["coerce_dates_numbers"] = """
SELECT o_orderkey,
  CASE o_orderkey % 6 WHEN 0 THEN CAST(date_trunc('year', o_orderdate) AS DATE)
    WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE)
    WHEN 2 THEN CAST(date_trunc('quarter', o_orderdate) AS DATE)
    ELSE CAST(o_orderdate AS DATE) END AS date,
  o_totalprice AS value
FROM orders WHERE o_orderkey % 6 <> 3 AND o_orderkey % 5 NOT IN (0, 1)"""

ORACLE["csv_numeric_cleanse"] = """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey AS DOUBLE) AS order_key,
  CASE WHEN o_orderkey % 7 IN (0, 1, 2, 4) THEN NULL ELSE o_totalprice END AS price,
  CAST(NULL AS DOUBLE) AS jobless_claims
FROM orders"""

ORACLE["weekday_filter"] = """
SELECT event_type, count(*) AS rows_read, count(*) FILTER (isodow(ts) <= 5) AS rows_kept,
  count(*) FILTER (isodow(ts) > 5) AS rows_removed
FROM events GROUP BY 1"""

# -- landed payloads ----------------------------------------------------------------

ORACLE["json_payload_rows"] = """
WITH m AS (
  SELECT l_returnflag AS f, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)
SELECT date, value, 'PRV/DS' || f || '/Q.' || year(date) || '/X' AS series_id, 'PRV' AS provider,
  'DS' || f AS dataset, 'Q.' || year(date) || '/X' AS series_code, 'Flag ' || f AS series_name,
  CASE WHEN f = 'A' THEN 'units' ELSE 'pieces' END AS unit, 'monthly' AS frequency, 'dbnomics' AS source
FROM m WHERE f <> 'N' AND month(date) NOT IN (6, 9)
  AND date BETWEEN DATE '1995-06-01' AND DATE '2001-06-30'"""

ORACLE["crypto_payload_rows"] = f"""
WITH {EVENT_BARS}
SELECT date, upper(series) AS symbol, 'USD' AS tsym, open, high, low, close,
  CAST(volume AS DOUBLE) AS volume_from, volume * 2.0::DOUBLE AS volume_to,
  upper(series) || '-USD' AS ticker
FROM bars WHERE series <> 'error' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"""

ORACLE["macro_observations"] = """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey AS DOUBLE) AS value
FROM orders WHERE o_orderkey % 4 <> 0"""

ORACLE["event_property_parse"] = """
SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum,
  count(json_extract(props, '$.k')) AS k_count
FROM events GROUP BY 1"""

ORACLE["paged_backfill_merge"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice + CASE
  WHEN o_orderdate >= DATE '2000-01-01' THEN 2 WHEN o_orderdate >= DATE '1997-01-01' THEN 1 ELSE 0 END AS o_totalprice
FROM orders"""

ORACLE["landed_mixed_files"] = """
SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker, o_totalprice AS close,
  CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS adj_close,
  CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 7 <> 0 THEN o_orderkey END AS volume
FROM orders"""

ORACLE["landed_many_files"] = """
SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker, CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice END AS close,
  o_orderkey AS volume, o_orderkey % 4 >= 2 AND o_orderkey % 10 <> 3 AS adjusted
FROM orders"""

ORACLE["landed_skips"] = """
WITH bars AS (SELECT CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AS late, o_orderkey % 10 <> 3 AS priced, o_orderkey % 10 <> 4 AS valid FROM orders),
n AS (
  SELECT count(*) AS total, count(*) FILTER (late) AS late, count(*) FILTER (late AND priced) AS priced,
    count(*) FILTER (late AND priced AND valid) AS valid FROM bars)
SELECT 0 AS position, 'files' AS stage, 163::BIGINT AS rows_read, 160::BIGINT AS rows_kept, 3::BIGINT AS rows_removed
UNION ALL SELECT 1, 'history_floor', total, late, total - late FROM n
UNION ALL SELECT 2, 'priced', late, priced, late - priced FROM n
UNION ALL SELECT 3, 'valid_bars', priced, valid, priced - valid FROM n"""

ORACLE["crypto_landed_values"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS ticker,
  CASE WHEN o_orderkey % 3 = 0 THEN DATE '2024-01-05' ELSE CAST(o_orderdate AS DATE) END AS date
FROM orders"""

ORACLE["asset_list_ids"] = """
SELECT 'C-' || o_custkey AS series_id FROM orders
UNION SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P'"""

ORACLE["unpivot_grid"] = f"""
WITH {ORDER_PANEL} SELECT date, replace(lower(series), ' ', '_') AS series, value FROM panel"""

ORACLE["grid_bars"] = f"""
WITH {EVENT_BARS}
SELECT date, series AS ticker, open, high, low, close, volume FROM bars"""

# -- picking, mapping, aligning -------------------------------------------------------

ORACLE["dedup_keep_last"] = """
SELECT user_id, CAST(ts AS DATE) AS date, event_type, value, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1"""

TWO_SOURCES = """lines AS (
  SELECT l_linestatus AS series, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS value
  FROM lineitem GROUP BY 1, 2),
stat AS (
  SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)"""

ORACLE["source_priority_pick"] = f"""
WITH {TWO_SOURCES}, both_sources AS (
  SELECT *, 'lines' AS source, 2 AS priority FROM lines
  UNION ALL SELECT *, 'orders', 1 FROM stat)
SELECT * FROM both_sources
QUALIFY row_number() OVER (PARTITION BY series, date ORDER BY priority, value DESC) = 1"""

_MAP_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in PRIORITY_MAP.items())
ORACLE["map_series"] = f"""
SELECT o.o_orderpriority, o.o_orderkey, o.o_totalprice, m.column_name
FROM orders o JOIN (VALUES {_MAP_VALUES}) AS m(series_id, column_name) ON o.o_orderpriority = m.series_id"""

_PIVOT = ", ".join(
    f"max(value) FILTER (series = '{a}') AS {b}" for a, b in ALL_PRIORITIES.items()
)
ORACLE["pivot_wide"] = f"WITH {ORDER_PANEL} SELECT date, {_PIVOT} FROM panel GROUP BY date"

ORACLE["outer_merge_by_date"] = """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS orders FROM orders GROUP BY 1),
l AS (SELECT CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS lines FROM lineitem GROUP BY 1),
e AS (SELECT CAST(ts AS DATE) AS date, max(value) AS events FROM events GROUP BY 1)
SELECT date, orders, lines, events FROM o FULL JOIN l USING (date) FULL JOIN e USING (date)"""

ORACLE["densify_calendar"] = f"WITH {DENSE_ORDERS} SELECT series, date, value FROM dense"

FILLED_MACRO = f"""{MACRO_ROWS}, {ORDER_PANEL},
observed AS (
  SELECT series, date, value FROM macro WHERE {WEEKDAY}
  UNION ALL SELECT 'held_' || series, date, floor(value / 10) FROM macro WHERE {WEEKDAY}),
days AS (SELECT date FROM panel WHERE {WEEKDAY} UNION SELECT date FROM observed),
grid AS (
  SELECT s.series, d.date, o.value
  FROM (SELECT DISTINCT series FROM observed) s CROSS JOIN days d
  LEFT JOIN observed o ON o.series = s.series AND o.date = d.date),
filled AS (
  SELECT series, date, last_value(value IGNORE NULLS) OVER {SO_FAR} AS value FROM grid)"""

ORACLE["forward_fill"] = f"WITH {FILLED_MACRO} SELECT series, date, value FROM filled"

# -- series metrics --------------------------------------------------------------------

ORACLE["event_return_vol7"] = f"""
WITH {EVENT_BARS}, wp AS (SELECT series, date, close AS value FROM bars WHERE {WEEKDAY}),
dense AS (
  SELECT s.series, c.date, wp.value
  FROM (SELECT DISTINCT series FROM wp) s CROSS JOIN (SELECT DISTINCT date FROM wp) c
  LEFT JOIN wp ON wp.series = s.series AND wp.date = c.date),
{RETURNS}, {VOLS}
SELECT series, date, value AS close, ret, {r('vol_7d', 4)} AS vol_7d,
  {r(f'vol_7d * {SQRT}', 4)} AS vol_7d_annualized
FROM vols"""

ORACLE["daily_return_pad"] = f"WITH {DENSE_ORDERS}, {RETURNS} SELECT series, date, value, ret FROM rets"

ORACLE["daily_return_nofill"] = f"""
WITH {DENSE_ORDERS}
SELECT series, date, value, value / nullif(lag(value) OVER ({W}), 0) - 1.0 AS ret FROM dense"""

ORACLE["rolling_vol_7"] = f"""
WITH {DENSE_ORDERS}, {RETURNS}, {VOLS}
SELECT series, date, {r('vol_7d', 4)} AS vol_7d, {r(f'vol_7d * {SQRT}', 4)} AS vol_7d_annualized FROM vols"""

ORACLE["rolling_vol_30_ann"] = f"""
WITH {DENSE_ORDERS}, {RETURNS}, {VOLS} SELECT series, date, {r('vol_30d', 4)} AS vol_30d FROM vols"""


def corr_sql(source: str, key: str) -> str:
    w = f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"
    return f"""complete AS (
  SELECT {key}, date, CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y
  FROM {source}),
corrs AS (
  SELECT {key}, date, CASE WHEN count(x) OVER {w} >= 30 AND min(x) OVER {w} < max(x) OVER {w}
      AND min(y) OVER {w} < max(y) OVER {w}
    THEN covar_samp(x, y) OVER {w} / nullif(stddev_samp(x) OVER {w} * stddev_samp(y) OVER {w}, 0) END AS corr
  FROM complete)"""


ORACLE["rolling_corr_90"] = f"""
WITH {DENSE_ORDERS}, {RETURNS}, pairs AS (
  SELECT p.pair, date, max(ret) FILTER (series = a) AS x, max(ret) FILTER (series = b) AS y
  FROM rets JOIN (VALUES ('urgent_high', '1-URGENT', '2-HIGH'), ('medium_low', '3-MEDIUM', '5-LOW'))
    AS p(pair, a, b) ON series IN (a, b)
  GROUP BY 1, 2),
{corr_sql('pairs', 'pair')}
SELECT pair, date, {r('corr', 6)} AS corr FROM corrs"""

ORACLE["rolling_zscore_252"] = f"""
WITH {FILLED_MACRO} SELECT series, date, {r(zscore(), 6)} AS z FROM filled"""

ORACLE["normalized_price"] = f"""
WITH {DENSE_ORDERS}
SELECT series, date, value / nullif(first_value(value IGNORE NULLS) OVER
  ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) * 100.0 AS norm
FROM dense"""

ORACLE["source_price_gap"] = f"""
WITH {TWO_SOURCES}, j AS (
  SELECT date, s.value AS orders, l.value AS lines
  FROM (SELECT date, max(value) AS value FROM stat GROUP BY date) s
  FULL JOIN (SELECT date, max(value) AS value FROM lines GROUP BY date) l USING (date))
SELECT date, orders, lines, orders - lines AS diff, (orders - lines) / nullif(orders, 0) * 100 AS diff_pct FROM j"""

# -- the wide table -----------------------------------------------------------------------


def _case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items()) + " END"


def gold_sql(fill_first: bool = False) -> str:
    prices = {k: YFINANCE_SERIES[v] for k, v in GOLD_TICKERS.items()}
    coins = {"F": CRYPTOCOMPARE_SERIES["BTC-USD"], "O": CRYPTOCOMPARE_SERIES["ETH-USD"]}
    fred = {"R": FRED_SERIES["DFF"], "A": FRED_SERIES["DGS10"], "N": FRED_SERIES["CSCICP02JPM460S"]}
    dbn = {"R": DBNOMICS_SERIES["OECD/MEI_CLI/LOLITOAA.JPN.M"], "N": DBNOMICS_SERIES["BIS/WS_CBPOL/D.XM"]}
    macro_list = ", ".join(f"'{c}'" for c in MACRO_COLUMNS)
    used = set(prices.values()) | set(coins.values()) | set(fred.values()) | set(dbn.values())

    def cell(series: str, field: str) -> str:
        if series not in used:
            return "CAST(NULL AS DOUBLE)"
        return f"max({field}) FILTER (series = '{series}')"

    columns = {c: cell(c, "value") for c in BASE_COLUMNS}
    for c, p in METRIC_PREFIX.items():
        columns[f"{p}_ret"] = cell(c, "ret")
        columns[f"{p}_norm"] = cell(c, "norm")
        if p in VOL_7D:
            columns[f"{p}_vol_7d"] = r(cell(c, "vol_7d"), 4)
            columns[f"{p}_vol_7d_annualized"] = r(f"{cell(c, 'vol_7d')} * {SQRT}", 4)
        if p in VOL_30D:
            columns[f"{p}_vol_30d"] = r(cell(c, "vol_30d"), 4)
    for c in ZSCORE_COLUMNS:
        columns[f"{c}_z"] = r(cell(c, "z"), 6)
    body = ",\n  ".join(f"{e} AS {n}" for n, e in columns.items())
    gaps = ", ".join(
        f"{a} - {b} AS {p}_price_diff, ({a} - {b}) / nullif({a}, 0) * 100 AS {p}_price_diff_pct"
        for p, (a, b) in PRICE_GAPS.items()
    )
    (corr_name, (left, right)), = CORRELATION_PAIRS.items()
    order = ", ".join(f.name for f in gold_schema().fields)
    return f"""
WITH {MACRO_ROWS}, sources AS (
  SELECT CAST(o_orderdate AS DATE) AS date, {_case('o_orderpriority', prices)} AS series,
         1 AS priority, o_orderkey AS version, o_totalprice AS value FROM orders
  UNION ALL
  SELECT CAST(l_shipdate AS DATE), {_case('l_linestatus', coins)}, 1, l_orderkey, l_extendedprice FROM lineitem
  UNION ALL
  SELECT date, {_case('series', fred)}, 1, 0, CASE WHEN series <> 'N' OR month(date) % 2 = 0 THEN value END FROM macro
  UNION ALL
  SELECT date, {_case('series', dbn)}, 2, 0, value FROM macro),
panel AS (
  SELECT series, date, value FROM sources
  WHERE series IS NOT NULL AND date >= DATE '{GOLD_FLOOR}'{'' if fill_first else f' AND {WEEKDAY}'}
  QUALIFY row_number() OVER (PARTITION BY series, date ORDER BY value IS NULL, priority, version DESC, value DESC) = 1),
grid AS (
  SELECT s.series, d.date, p.value
  FROM (SELECT DISTINCT series FROM panel) s CROSS JOIN (SELECT DISTINCT date FROM panel) d
  LEFT JOIN panel p ON p.series = s.series AND p.date = d.date),
all_days AS (
  SELECT series, date, CASE WHEN series IN ({macro_list})
    THEN last_value(value IGNORE NULLS) OVER {SO_FAR} ELSE value END AS value FROM grid),
dense AS (SELECT * FROM all_days WHERE {WEEKDAY}),
{RETURNS}, {VOLS},
full_metrics AS (
  SELECT *, value / nullif(first_value(value IGNORE NULLS) OVER
    ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) * 100.0 AS norm,
    {zscore()} AS z FROM vols),
wide AS (
  SELECT date, {body} FROM full_metrics GROUP BY date),
pairs AS (
  SELECT 'p' AS pair, date, max(ret) FILTER (series = '{left}') AS x, max(ret) FILTER (series = '{right}') AS y
  FROM rets GROUP BY date),
{corr_sql('pairs', 'pair')},
everything AS (
  SELECT wide.*, {r('corr', 6)} AS {corr_name}, {gaps} FROM wide JOIN corrs USING (date))
SELECT {order} FROM everything"""


ORACLE["gold_wide_metrics"] = gold_sql()
ORACLE["gold_append"] = gold_sql()
ORACLE["gold_append_filled_first"] = gold_sql(fill_first=True)
ORACLE["published_base_columns"] = (
    f"SELECT date, {', '.join(BASE_COLUMNS)} FROM ({gold_sql()})"
)

# -- endless series --------------------------------------------------------------------------

ORACLE["endless_series"] = """
WITH ticks AS (
  SELECT CASE WHEN event_id % 10 < 7 THEN 'busy' ELSE event_type END AS series, ts, event_id,
    CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events)
SELECT series, event_id, value, last_value(value IGNORE NULLS) OVER w AS filled,
  value / nullif(first_value(value IGNORE NULLS) OVER w, 0) * 100.0 AS norm,
  value / nullif(max(value) OVER w, 0) - 1.0 AS drawdown
FROM ticks WINDOW w AS (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

# -- upserts and marks ------------------------------------------------------------------------

DAILY_ORDERS = """daily AS (
  SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS high, count(*) AS orders
  FROM orders GROUP BY 1)"""

ORACLE["upsert_by_date"] = f"""
WITH {DAILY_ORDERS}
SELECT date, high, orders FROM daily WHERE date < DATE '2001-01-01'
  OR (date <= DATE '2001-01-31' AND date NOT IN (SELECT date FROM daily WHERE date >= DATE '2001-01-01'))
UNION ALL SELECT date, NULL, orders * 10 FROM daily WHERE date >= DATE '2001-01-01'"""

ORACLE["upsert_touched_months"] = f"""
WITH {DAILY_ORDERS}
SELECT date, high, CASE WHEN date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' AND day(date) <> 5
  THEN orders * 10 ELSE orders END AS orders FROM daily"""

ORACLE["compacted_bars"] = """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS bars, sum(l_quantity) AS quantity,
  count(DISTINCT l_partkey) AS parts, true AS as_planned
FROM lineitem GROUP BY 1"""

ORACLE["upsert_cells_by_date"] = f"""
WITH {DAILY_ORDERS}
SELECT date, CASE WHEN date <= DATE '2001-01-31' THEN high END AS high,
  CASE WHEN date < DATE '2001-01-01' THEN orders ELSE orders * 10 END AS orders
FROM daily"""

ORACLE["append_newer_than_max"] = f"""
WITH {DAILY_ORDERS}
SELECT * FROM daily WHERE date > (SELECT max(date) FROM daily WHERE date <= DATE '2000-12-31')"""

ORACLE["high_water_mark"] = "SELECT CAST(max(o_orderdate) AS DATE) AS max_date FROM orders"

_GOLD_NULLS = ", ".join(
    "high AS sp500" if f.name == "sp500" else f"CAST(NULL AS DOUBLE) AS {f.name}"
    for f in gold_schema().fields
    if f.name != "date"
)
ORACLE["warehouse_append"] = f"""
WITH {DAILY_ORDERS}
SELECT date, {_GOLD_NULLS} FROM daily
WHERE date > (SELECT max(date) FROM daily WHERE date <= DATE '2000-12-31')"""

_COLUMN_VALUES = ", ".join(f"('{f.name}')" for f in gold_schema().fields)
ORACLE["warehouse_columns"] = f"""
WITH {DAILY_ORDERS}
SELECT column_name, CASE WHEN column_name IN ('date', 'gold') THEN (SELECT count(*) FROM daily) ELSE 0 END AS filled
FROM (VALUES {_COLUMN_VALUES}) AS c(column_name)"""

# -- universes ------------------------------------------------------------------------------------

_ENDINGS = "[" + ", ".join(f"'{e}'" for e in SYMBOL_ENDINGS) + "]"


def symbol_sql(key: str) -> str:
    letters = " || ".join(f"chr(CAST(65 + ({key} // {26**i}) % 26 AS INTEGER))" for i in range(3))
    return f"{letters} || ({_ENDINGS})[{key} % 12 + 1]"


def valid_sql(s: str) -> str:
    bad = " OR ".join(f"contains(upper({s}), '{p}')" for p in ("-WS", "-WT", "-UN", "-U", "-R", "-RT", "^", "+", "~"))
    return (
        f"(NOT ({bad}) AND NOT regexp_matches(upper({s}), '-P\\pL?$') AND length({s}) <= 5"
        f" AND (NOT regexp_matches({s}, '[0-9]') OR {s} IN ('BRK.A', 'BRK.B', 'BF.A', 'BF.B')))"
    )


UNIVERSE = f"""listing AS (
  SELECT {symbol_sql('p_partkey')} AS symbol, trim(p_name) AS name, unnest(
    CASE WHEN p_size > 40 THEN [p_partkey % 3, (p_partkey + 1) % 3] ELSE [p_partkey % 3] END) AS place
  FROM part),
listed AS (
  SELECT symbol, name, ['NASDAQ', 'NYSE', 'AMEX'][place + 1] AS exchange FROM listing
  WHERE {valid_sql('symbol')}
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY place DESC, name DESC) = 1),
weekly AS (
  SELECT {symbol_sql('l_partkey')} AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    max(l_extendedprice) * 100 AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2),
quotes AS (
  SELECT symbol, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM weekly GROUP BY 1),
volumes AS (
  SELECT symbol, round(close, 2) AS price, CAST(floor(CAST(volume AS BIGINT) / 5.0) AS BIGINT) AS avg_volume,
    round(close * (CAST(volume AS BIGINT) / 5.0::DOUBLE), 2) AS dollar_volume
  FROM quotes WHERE close > 0 AND volume > 0),
universe AS (
  SELECT symbol, name, exchange, price, avg_volume, dollar_volume
  FROM listed JOIN volumes USING (symbol) WHERE dollar_volume >= 1000000)"""

ORACLE["ticker_validity"] = f"""
WITH words AS (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS symbol FROM documents),
counted AS (SELECT symbol, count(*) AS uses FROM words GROUP BY 1)
SELECT {valid_sql('symbol')} AND symbol <> '' AS valid, CAST(length(symbol) AS INTEGER) AS length,
  count(*) AS symbols, CAST(sum(uses) AS BIGINT) AS uses
FROM counted GROUP BY 1, 2"""

ORACLE["exchange_symbols"] = f"WITH {UNIVERSE} SELECT * FROM listed"
ORACLE["universe_dollar_volume"] = f"WITH {UNIVERSE} SELECT * FROM universe"
ORACLE["universe_published"] = ORACLE["universe_dollar_volume"]
ORACLE["universe_by_exchange"] = f"WITH {UNIVERSE} SELECT exchange, count(*) AS stocks FROM universe GROUP BY 1"
ORACLE["universe_tiers"] = f"""
WITH {UNIVERSE}
SELECT '$100M+' AS tier, count(*) AS stocks FROM universe WHERE dollar_volume >= 100000000
UNION ALL SELECT '$10M-$100M', count(*) FROM universe WHERE dollar_volume >= 10000000 AND dollar_volume < 100000000
UNION ALL SELECT '$1M-$10M', count(*) FROM universe WHERE dollar_volume >= 1000000 AND dollar_volume < 10000000"""
ORACLE["universe_top10"] = f"WITH {UNIVERSE} SELECT * FROM universe ORDER BY dollar_volume DESC, symbol LIMIT 10"
ORACLE["universe_header"] = f"""
WITH {UNIVERSE}
SELECT '2024-01-31T00:00:00Z' AS generated_at, count(*) AS total_count,
  1000000.0::DOUBLE AS min_dollar_volume_threshold, 'NASDAQ,NYSE,AMEX' AS exchanges FROM universe"""

_COINS = "[" + ", ".join(f"'{c.upper()}'" for c in COIN_SYMBOLS) + "]"
_EXCLUDED = ", ".join(f"'{c}'" for c in EXCLUDED_COINS)
COINS = f"""coins AS (
  SELECT 'coin-' || c_custkey AS coingecko_id, ({_COINS})[c_custkey % 8 + 1] AS symbol, c_name AS name,
    c_acctbal * 50 AS market_cap, c_nationkey AS market_cap_rank, c_acctbal * 400 AS total_volume_24h,
    c_acctbal AS current_price, '2024-01-31' AS last_updated
  FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal * 400 >= 1000000),
universe AS (
  SELECT coingecko_id, symbol, name, symbol || '-USD' AS yahoo_symbol, symbol AS cryptocompare_symbol,
    market_cap, market_cap_rank, total_volume_24h, current_price, last_updated
  FROM coins WHERE symbol NOT IN ({_EXCLUDED}))"""
ORACLE["coin_universe"] = f"WITH {COINS} SELECT * FROM universe"
ORACLE["coin_top20"] = f"""
WITH {COINS} SELECT * FROM universe ORDER BY total_volume_24h DESC, coingecko_id LIMIT 20"""

# -- load state -----------------------------------------------------------------------------------

LOG = """log AS (
  SELECT event_type AS asset_class, 'src_' || (user_id % 5) AS source, CAST(ts AS DATE) AS end_date,
    count(*) AS records, CASE WHEN max(value) > 200 THEN 'failed' ELSE 'success' END AS status,
    CAST(CAST(ts AS DATE) AS VARCHAR) || 'T03:00:00' AS run_timestamp
  FROM events GROUP BY 1, 2, 3, 6),
known AS (
  SELECT asset_class, source, max(end_date) AS last_update_date, 'success' AS status,
    arg_max(records, end_date) AS records_fetched, max(run_timestamp) AS last_run_timestamp
  FROM log WHERE status = 'success' AND end_date <= DATE '2024-01-24' AND asset_class <> 'error'
  GROUP BY 1, 2),
plan AS (SELECT DISTINCT asset_class, source FROM log)"""


def windows_sql(latest: str, lookback: int, end: str) -> str:
    return f"""
WITH {LOG}, dated AS (
  SELECT plan.asset_class, plan.source, coalesce(last_update_date, DATE '2023-12-31') AS last_update_date
  FROM plan LEFT JOIN known USING (asset_class, source))
SELECT asset_class, source, last_update_date, last_update_date + {1 - lookback} AS start_date,
  DATE '{end}' AS end_date
FROM dated WHERE last_update_date + 1 <= DATE '{latest}'"""


# Monday 2024-01-29: the last trading day is Friday, the last calendar day is Sunday
ORACLE["load_windows"] = windows_sql("2024-01-26", 0, "2024-01-26")
ORACLE["load_windows_lookback"] = windows_sql("2024-01-28", 7, "2024-01-27")

ORACLE["state_upsert"] = f"""
WITH {LOG}, latest AS (
  SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY asset_class, source ORDER BY end_date DESC) = 1)
SELECT l.asset_class, l.source,
  CASE WHEN l.status = 'success' THEN l.end_date
       ELSE coalesce(k.last_update_date, DATE '2025-11-30') END AS last_update_date,
  l.status, CASE WHEN l.status = 'success' THEN l.records ELSE 0 END AS records_fetched,
  l.run_timestamp AS last_run_timestamp
FROM latest l LEFT JOIN known k USING (asset_class, source)
UNION ALL
SELECT * FROM known WHERE (asset_class, source) NOT IN (SELECT (asset_class, source) FROM latest)"""

ORACLE["state_document_roundtrip"] = f"WITH {LOG} SELECT * FROM known"
ORACLE["run_summary"] = f"""
WITH {LOG} SELECT status, count(*) AS sources, CAST(sum(records) AS BIGINT) AS total_records FROM log GROUP BY 1"""
ORACLE["run_plan_with_series"] = """
SELECT user_id, count(DISTINCT event_type) AS series_count FROM events WHERE value > 100 GROUP BY 1"""
ORACLE["source_reliability"] = f"""
WITH {LOG}
SELECT asset_class, source, count(*) AS runs,
  CAST(count(*) FILTER (status = 'success') AS DOUBLE) / count(*) AS success_rate,
  CAST(sum(records) AS BIGINT) AS total_records
FROM log GROUP BY 1, 2"""

# -- reports ----------------------------------------------------------------------------------------

ORACLE["run_report"] = f"""
WITH {ORDER_PANEL}
SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS row_count, 3 AS column_count FROM panel"""

ORACLE["series_listing"] = """
SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS series_count, min(o_orderpriority) AS first_series,
  max(o_orderpriority) AS last_series
FROM orders GROUP BY 1"""

ORACLE["records_per_date"] = "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS records FROM orders GROUP BY 1"

ORACLE["preview_latest"] = f"WITH {ORDER_PANEL} SELECT * FROM panel ORDER BY date DESC, series LIMIT 5"

ORACLE["max_drawdown"] = f"""
WITH {ORDER_PANEL}, dd AS (
  SELECT series, value / nullif(max(value) OVER {SO_FAR}, 0) - 1.0 AS d FROM panel)
SELECT series, min(d) AS max_drawdown FROM dd GROUP BY 1"""

ORACLE["performance_rank"] = """
WITH p AS (
  SELECT o_custkey AS series, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS value
  FROM orders GROUP BY 1, 2),
ends AS (
  SELECT series, arg_min(value, date) AS first_value, arg_max(value, date) AS last_value
  FROM p WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1),
perf AS (SELECT *, last_value / nullif(first_value, 0) - 1.0 AS total_return FROM ends)
SELECT *, rank() OVER (ORDER BY total_return DESC NULLS LAST) AS rank FROM perf"""

_NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ORACLE["corr_matrix"] = f"""
WITH {DENSE_ORDERS}, {RETURNS}, joined AS (
  SELECT a.series AS left_series, b.series AS right_series, a.ret AS x, b.ret AS y
  FROM rets a JOIN rets b ON a.date = b.date AND a.series < b.series
  WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)
SELECT left_series, right_series, count(*) AS pairs,
  {r('covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0)', 6)} AS corr
FROM joined GROUP BY 1, 2"""

ORACLE["shock_days"] = f"""
WITH {DENSE_ORDERS}, {RETURNS}, {VOLS}
SELECT series, date, value, ret FROM vols WHERE abs(ret) > 2.0 * vol_7d"""

ORACLE["macro_yoy"] = f"""
WITH {FILLED_MACRO}, monthly AS (
  SELECT series, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(value, date) AS value
  FROM filled WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT m.series, m.month, m.value, m.value / nullif(a.value, 0) - 1.0 AS mom,
  m.value / nullif(b.value, 0) - 1.0 AS yoy
FROM monthly m
LEFT JOIN monthly a ON a.series = m.series AND a.month = m.month - INTERVAL 1 MONTH
LEFT JOIN monthly b ON b.series = m.series AND b.month = m.month - INTERVAL 12 MONTH"""

ORACLE["series_quality"] = """
WITH d AS (
  SELECT o_custkey AS series, CAST(o_orderdate AS DATE) AS date, count(*) AS n,
    count(*) FILTER (o_orderstatus <> 'P') AS known
  FROM orders GROUP BY 1, 2),
g AS (SELECT *, date - lag(date) OVER (PARTITION BY series ORDER BY date) AS gap FROM d)
SELECT series, CAST(sum(n) AS BIGINT) AS row_count,
  CAST(sum(n) - sum(known) AS DOUBLE) / sum(n) AS null_rate, max(date) AS last_date,
  count(*) FILTER (gap > 7) AS gaps, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows,
  CAST(DATE '2001-12-31' - max(date) AS INTEGER) AS days_stale
FROM g GROUP BY 1"""

# -- lake and stream -----------------------------------------------------------------------------------

ORACLE["lake_silver_scan"] = f"""
WITH {EVENT_BARS}
SELECT date, upper(series) AS ticker, {_case('series', EVENT_CLASSES)} AS asset_class, 'yfinance' AS source,
  CASE WHEN date <= DATE '2024-01-28' THEN 'historical' ELSE 'daily' END AS load_type,
  open, high, low, close, round(close / 2, 4) AS adjusted_close, volume,
  CASE WHEN date > DATE '2024-01-28' THEN CAST(year(date) AS INTEGER) END AS year,
  CASE WHEN date > DATE '2024-01-28' THEN CAST(month(date) AS INTEGER) END AS month,
  CASE WHEN date > DATE '2024-01-28' THEN CAST(day(date) AS INTEGER) END AS day,
  '2024-02-01T00:00:00' AS fetch_timestamp
FROM bars"""

ORACLE["lake_macro_scan"] = f"""
WITH {MACRO_ROWS}
SELECT date, series AS indicator, value, 'economic' AS asset_class,
  CASE series WHEN 'R' THEN 'fred' ELSE 'dbnomics' END AS data_source,
  CASE series WHEN 'A' THEN 'imf' END AS provider, 'historical' AS load_type
FROM macro"""

ORACLE["stream_daily_upsert"] = """
SELECT user_id, CAST(ts AS DATE) AS date, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1"""

# -- landed documents, outcomes, audit ----------------------------------------------------------

ORACLE["coin_pages_until_threshold"] = f"""
WITH {COINS}, volumes AS (
  SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal * 400 ELSE 0 END AS volume FROM customer),
pages AS (
  SELECT *, 1 + floor(greatest(0, 4000000 - volume) / 250000) + CASE WHEN c_custkey % 97 = 0 THEN 15 ELSE 0 END AS page FROM volumes)
SELECT * FROM universe WHERE coingecko_id IN (
  SELECT 'coin-' || c_custkey FROM pages WHERE page <= (SELECT min(page) FROM pages WHERE volume < 1000000))"""

ORACLE["exchange_symbol_files"] = ORACLE["exchange_symbols"]

ORACLE["series_lists"] = """
SELECT 'fred' AS "group", 'F-' || o_custkey AS series_id FROM orders
UNION SELECT 'fred', o_orderpriority FROM orders
UNION SELECT 'Group' || (o_custkey % 7), 'D-' || o_custkey FROM orders WHERE o_custkey % 5 <> 0"""

ORACLE["run_outcomes"] = """
WITH groups AS (
  SELECT 'Group' || (o_custkey % 7) AS g, CASE WHEN o_custkey % 7 = 3 THEN 0 ELSE count(*) FILTER (o_orderstatus = 'P') END AS series, count(*) AS records
  FROM orders GROUP BY 1, o_custkey % 7),
runs AS (
  SELECT selector, g, CASE WHEN series = 0 OR (selector <> 'all' AND lower(g) <> lower(selector)) THEN 'skipped'
    WHEN g IN ('Group2', 'Group5') THEN 'failed' ELSE 'success' END AS status, records
  FROM groups CROSS JOIN (VALUES ('all'), ('gROUP4')) AS s(selector))
SELECT selector, status, count(*) AS sources, string_agg('economic/dbnomics_' || g, ', ' ORDER BY g) AS names,
  CAST(sum(CASE WHEN status = 'success' THEN records ELSE 0 END) AS BIGINT) AS total_records
FROM runs GROUP BY 1, 2"""

ORACLE["audit_stamp"] = f"""
WITH {MACRO_ROWS}
SELECT series AS indicator, count(*) AS observations, 1::BIGINT AS stamps, true AS fresh FROM macro GROUP BY 1"""

ORACLE["published_order"] = f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS place FROM ({gold_sql()})"

ORACLE["late_arrivals"] = f"""
WITH {ORDER_PANEL}, marked AS (SELECT *, series = '1-URGENT' AND year(date) = 1996 AS late FROM panel)
SELECT series, count(*) AS days, {r('sum(value)', 2)} AS total, count(*) FILTER (NOT late) AS in_time,
  min(date) FILTER (late) AS start_date, max(date) FILTER (late) AS end_date, nullif(count(*) FILTER (late), 0) AS late_rows
FROM marked GROUP BY series"""

ORACLE["append_after_stored_mark"] = ORACLE["append_newer_than_max"]

ORACLE["distinct_series_of_spans"] = """
WITH days AS (SELECT CAST(ts AS DATE) AS date, event_type, user_id FROM events)
SELECT 'first_half' AS span, event_type, count(*) AS rows, count(DISTINCT user_id) AS users, true AS within_bound
FROM days WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' GROUP BY 2
UNION ALL
SELECT 'all', event_type, count(*), count(DISTINCT user_id), true
FROM days WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' GROUP BY 2"""
