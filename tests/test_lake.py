import datetime as dt
import os
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tideline.operators.cleanse import silver_macro, silver_prices
from tideline.operators import quality
from tideline.plans.silver import bronze_to_silver, run_silver
from tideline.schemas import BRONZE_PRICES, SILVER_MACRO, SILVER_PRICES, gold_schema
from tideline.session import CHECKPOINT_CONF, materialize, scratch_path, shared_dir
from tideline.sinks import lake as sink
from tideline.sinks import warehouse
from tideline.sources import census, jdbc, lake
from tideline.sources.lake import scan_prefix

D = dt.date


def bars(spark, days, ticker="A", close=2.0):
    rows = [(dt.datetime.combine(d, dt.time()), 1.0, 3.0, 1.0, close, 2.0, 5, ticker, "t") for d in days]
    return spark.createDataFrame(rows, BRONZE_PRICES)


def land(df, root, asset_class, load_type, source="yfinance", provider=None):
    keyed = df.withColumns({"asset_class": F.lit(asset_class), "source": F.lit(source), "load_type": F.lit(load_type)})
    if provider:
        keyed = keyed.withColumn("provider", F.lit(provider))
    return sink.write_raw(keyed, root, load_type, provider is not None)


def test_layout_counts_and_rerun(spark, tmp_path):
    root = str(tmp_path)
    days = [D(2024, 1, 2), D(2024, 1, 3)]
    assert land(bars(spark, days), root, "stocks", "daily") == 2
    folder = tmp_path / "raw/asset_class=stocks/source=yfinance/load_type=daily/year=2024/month=01/day=02"
    assert folder.is_dir()
    # a re-run of one day replaces that day only
    assert land(bars(spark, days[:1], close=7.0), root, "stocks", "daily") == 1
    out = lake.scan_layer(spark, root, "raw", BRONZE_PRICES, "yfinance", ["stocks"])
    assert sorted((r.date.day, r.close) for r in out.collect()) == [(2, 7.0), (3, 2.0)]


def test_backfill_batches_add_up(spark, tmp_path):
    for ticker in ("A", "B"):
        land(bars(spark, [D(2020, 1, 2)], ticker), str(tmp_path), "stocks", "historical")
    out = lake.scan_layer(spark, str(tmp_path), "raw", BRONZE_PRICES, "yfinance", ["stocks"])
    assert sorted(r.ticker for r in out.collect()) == ["A", "B"]


def test_silver_job_end_to_end(spark, tmp_path):
    root = str(tmp_path)
    land(bars(spark, [D(2017, 1, 2), D(2019, 1, 2)]), root, "stocks", "historical")
    land(bars(spark, [D(2024, 1, 2), D(2024, 1, 3)], close=4.0), root, "stocks", "daily")
    for _ in range(2):  # a re-run replaces
        assert run_silver(spark, root, "yfinance", "historical") == 1
        assert run_silver(spark, root, "yfinance", "daily", "2024-01-03") == 1
    assert run_silver(spark, root, "yfinance", "daily", "2024-01-09") == 0
    every = lake.scan_layer(spark, root, "transformed", SILVER_PRICES, "yfinance")
    assert sorted((r.date, r.load_type) for r in every.collect()) == [(D(2019, 1, 2), "historical"), (D(2024, 1, 3), "daily")]
    one = lake.scan_layer(spark, root, "transformed", SILVER_PRICES, "yfinance", day="2024-01-03")
    assert [(r.date, r.year, r.month, r.day) for r in one.collect()] == [(D(2024, 1, 3), 2024, 1, 3)]


def test_rows_all_filtered_still_counts_zero(spark, tmp_path):
    root = str(tmp_path)
    land(bars(spark, [D(2024, 1, 2)], close=-1.0), root, "stocks", "historical")
    assert run_silver(spark, root, "yfinance", "historical") == 0


def test_missing_prefix_is_typed_and_empty(spark, tmp_path):
    out = lake.scan_layer(spark, str(tmp_path), "transformed", SILVER_PRICES, "yfinance")
    assert out.schema.names == SILVER_PRICES.names and out.isEmpty()
    assert lake.find_layer(spark, str(tmp_path), "raw", BRONZE_PRICES, "yfinance") is None


def test_day_scan_lists_only_its_folder(spark, tmp_path):
    root = str(tmp_path)
    land(bars(spark, [D(2024, 1, i) for i in range(2, 6)]), root, "stocks", "daily")
    one = lake.scan_layer(spark, root, "raw", BRONZE_PRICES, "yfinance", ["stocks"], day="2024-01-04")
    assert {f.split("/load_type=daily/")[1].rsplit("/", 1)[0] for f in one.inputFiles()} == {"year=2024/month=01/day=04"}


def test_macro_scan_reads_provider_and_flat_folders(spark, tmp_path):
    root = str(tmp_path)
    macro = lambda sid: spark.createDataFrame([(D(2024, 1, 1), 1.0, sid)], "date date, value double, series_id string")
    land(macro("f"), root, "economic", "historical", "fred")
    land(macro("p"), root, "economic", "historical", "dbnomics", "imf")
    land(macro("q"), root, "economic", "historical", "dbnomics")
    for source in ("fred", "dbnomics"):
        run_silver(spark, root, source, "historical")
    out = lake.scan_macro(spark, root, "transformed", SILVER_MACRO)
    assert {(r.indicator, r.data_source, r.provider) for r in out.collect()} == {
        ("f", "fred", None), ("p", "dbnomics", "imf"), ("q", "dbnomics", None),
    }


def test_unlisted_providers_and_classes_are_read(spark, tmp_path):
    root = str(tmp_path)
    macro = lambda sid: spark.createDataFrame([(D(2024, 1, 1), 1.0, sid)], "date date, value double, series_id string")
    for load_type in ("historical", "daily"):
        land(macro("p"), root, "economic", load_type, "dbnomics", "newone")
        land(macro("q"), root, "economic", load_type, "dbnomics", "a:b c")
        land(macro("b"), root, "bonds", load_type, "fred")
        land(macro("r"), root, "rates", load_type, "dbnomics", "newone")
        land(bars(spark, [D(2024, 1, 1)]), root, "funds", load_type)
    assert run_silver(spark, root, "fred", "historical") == 1
    assert run_silver(spark, root, "dbnomics", "historical") == 3
    assert run_silver(spark, root, "yfinance", "historical") == 1
    assert run_silver(spark, root, "dbnomics", "daily", "2024-01-01") == 3
    economic = lake.scan_macro(spark, root, "transformed", SILVER_MACRO)
    assert sorted((r.indicator, r.provider) for r in economic.collect()) == [("p", "newone")] * 2 + [("q", "a:b c")] * 2
    every = lake.scan_macro(spark, root, "transformed", SILVER_MACRO, ["historical"], asset_classes=None)
    assert {(r.indicator, r.asset_class, r.data_source, r.provider) for r in every.collect()} == {
        ("p", "economic", "dbnomics", "newone"), ("q", "economic", "dbnomics", "a:b c"), ("b", "bonds", "fred", None),
        ("r", "rates", "dbnomics", "newone"),
    }


def test_nanosecond_and_corrupt_files(spark, tmp_path):
    folder = tmp_path / "raw/asset_class=stocks/source=yfinance/load_type=historical"
    os.makedirs(folder)
    pdf = pd.DataFrame({
        "date": pd.to_datetime(["2020-03-02T00:00:00.000000001"]), "open": [1.0], "high": [2.0], "low": [1.0],
        "close": [float("nan")], "adj_close": [1.0], "volume": [5], "ticker": ["N"], "fetch_timestamp": ["t"],
    })
    good = pd.concat([pdf, pdf.assign(close=1.5)])
    pq.write_table(pa.Table.from_pandas(good, preserve_index=False), folder / "a.parquet", version="2.6")
    assert "ns" in str(pq.read_schema(folder / "a.parquet").field("date").type)
    rows = bronze_to_silver(spark, str(tmp_path), "yfinance", "historical").collect()
    assert [(r.date, r.close, r.ticker) for r in rows] == [(D(2020, 3, 2), 1.5, "N")]
    (folder / "z.parquet").write_bytes(b"not parquet")
    base = str(tmp_path / "raw")
    tolerant = lake.scan_prefix(spark, base, str(folder), BRONZE_PRICES, tolerate_corrupt=True, landed=True)
    assert tolerant.count() == 2
    with pytest.raises(Exception, match="not a Parquet file|CANNOT_READ|FAILED_READ_FILE"):
        lake.scan_prefix(spark, base, str(folder), BRONZE_PRICES, landed=True).collect()


def test_folder_without_readable_files(spark, tmp_path):
    for source in ("yfinance", "cryptocompare", "dbnomics"):
        asset_class = {"yfinance": "stocks", "cryptocompare": "crypto", "dbnomics": "economic"}[source]
        folder = tmp_path / f"raw/asset_class={asset_class}/source={source}/load_type=historical"
        os.makedirs(folder)
        assert run_silver(spark, str(tmp_path), source, "historical") == 0
        (folder / "a.parquet").write_bytes(b"not parquet")
    assert run_silver(spark, str(tmp_path), "dbnomics", "historical") == 0
    with pytest.raises(ValueError, match="none could be read"):
        run_silver(spark, str(tmp_path), "cryptocompare", "historical")


def test_silver_file_sizing(spark, tmp_path):
    df = silver_prices(bars(spark, [D(2024, 1, 2)] * 50).coalesce(1), "stocks", "historical")
    sink.write_layer(df, str(tmp_path), "transformed", by_day=False, rows_per_file=20)
    files = list((tmp_path / "transformed").rglob("*.parquet"))
    assert len(files) == 3
    assert lake.scan_layer(spark, str(tmp_path), "transformed", SILVER_PRICES, "yfinance", ["stocks"]).count() == 50


def test_conform_types_missing_columns(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0)], "date string, value double")
    out = silver_macro(df, "economic", "fred", "daily", provider=None)
    assert out.schema.names == SILVER_MACRO.names
    assert out.first().provider is None and out.first().indicator is None


@pytest.mark.parametrize(
    ("key", "suffix", "want"),
    [
        (" /a/b.parquet. ", ".parquet", "a/b.parquet"),
        ("/a/b.PARQUET", ".parquet", "a/b.PARQUET"),
        ("a.csv...", ".csv", "a.csv"),
    ],
)
def test_checked_key(key, suffix, want):
    assert lake.checked_key(key, suffix) == want


def test_checked_key_refuses_other_files():
    with pytest.raises(ValueError):
        lake.checked_key("a/b.csv", ".parquet")


def test_reconcile_and_ddl(spark):
    df = spark.createDataFrame([("2024-01-02", 1.0, 2)], "DATE string, SP500 double, other int")
    out = warehouse.reconcile(df)
    assert out.schema.names == gold_schema().names and len(out.columns) == 96
    assert out.first().sp500 == 1.0 and out.first().gold is None
    with pytest.raises(ValueError):
        warehouse.reconcile(df.drop("DATE"))
    ddl = warehouse.create_table_sql("market_data")
    assert ddl.count("DOUBLE PRECISION") == 95 and "    date DATE," in ddl
    present = [c for c in gold_schema().names if c not in ("cc_de", "cc_de_z")] + ["cpi_ea"]
    assert warehouse.alter_table_sql("t", present) == [
        "ALTER TABLE t ADD COLUMN cc_de DOUBLE PRECISION",
        "ALTER TABLE t ADD COLUMN cc_de_z DOUBLE PRECISION",
        "ALTER TABLE t DROP COLUMN cpi_ea",
    ]


def test_warehouse_append_and_options(spark):
    df = spark.createDataFrame([(f"2024-01-{i:02d}", float(i)) for i in range(1, 11)], "date string, sp500 double")
    mark = spark.createDataFrame([(D(2024, 1, 8),)], "date date")
    days = lambda d: sorted(r.date.day for r in d.collect())
    assert days(warehouse.rows_to_append(df, mark)) == [9, 10]
    assert len(days(warehouse.rows_to_append(df, spark.createDataFrame([(None,)], "date date")))) == 10
    conn = jdbc.connection("jdbc:postgresql://h/db", "u", "p")
    assert warehouse.full_load_options(conn, "t") == {**conn, "dbtable": "t", "truncate": "true", "numPartitions": "8"}
    assert warehouse.append_options(conn, "t")["numPartitions"] == "1"
    assert jdbc.mark_query("t") == "(SELECT MAX(date) AS max_date FROM t) AS t"


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get(CHECKPOINT_CONF)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = materialize(spark.range(3), "ids")
    assert df.count() == 3 and "InMemoryFileIndex" in df._jdf.queryExecution().executedPlan().toString()


def test_landed_files_of_other_writers(spark, tmp_path):
    """Nanosecond footers, a column more and a volume with gaps beside a plain file; a broken file is left out."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tideline.schemas import BRONZE_PRICES
    from tideline.sources.lake import scan_prefix

    when = pd.to_datetime(["2024-01-02", "2024-01-03"])
    plain = pa.table({"date": pa.array(when.astype("datetime64[us]")), "ticker": ["a", "b"], "volume": pa.array([1, 2], pa.int64())})
    nanos = pa.table({"date": pa.array(when.astype("datetime64[ns]")), "ticker": ["c", "d"], "volume": [3.0, float("nan")], "adj_close": [7.0, 8.0]})
    more = pa.table({"date": pa.array(when.astype("datetime64[us]")), "ticker": ["e", "f"], "volume": pa.array([5, 6], pa.int64()), "close": [1.0, 2.0]})
    pq.write_table(plain, tmp_path / "a.parquet")
    pq.write_table(nanos, tmp_path / "b.parquet", version="2.6")
    pq.write_table(more, tmp_path / "c.parquet")
    (tmp_path / "d.parquet").write_bytes(b"broken")
    got = scan_prefix(spark, str(tmp_path), str(tmp_path), BRONZE_PRICES, tolerate_corrupt=True, landed=True)
    rows = {r.ticker: (str(r.date.date()), r.volume, r.adj_close, r.close) for r in got.collect()}
    assert rows == {
        "a": ("2024-01-02", 1, None, None), "b": ("2024-01-03", 2, None, None), "c": ("2024-01-02", 3, 7.0, None),
        "d": ("2024-01-03", None, 8.0, None), "e": ("2024-01-02", 5, None, 1.0), "f": ("2024-01-03", 6, None, 2.0),
    }


def land_files(folder, count, kinds):
    """Small files of several physical schemas, in turn."""
    os.makedirs(folder)
    for i in range(count):
        columns = {"ticker": [f"t{i}"], "close": [float(i)], **kinds[i % len(kinds)]}
        pq.write_table(pa.table(columns), folder / f"f{i:04d}.parquet")


KINDS = [
    {"date": pa.array([dt.datetime(2024, 1, 2)], pa.timestamp("us"))},
    {"date": pa.array([1704153600 * 10**9], pa.int64())},
    {"date": pa.array([1704153600 * 10**9], pa.int64()), "volume": [1.0]},
    {"date": pa.array([dt.date(2024, 1, 2)], pa.date32()), "volume": pa.array([7], pa.int64()), "open": [1.0]},
]


def jobs_of(spark, run):
    group = f"jobs-{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    found = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(found)


def test_number_of_jobs_does_not_grow_with_the_files(spark, tmp_path):
    jobs = []
    for count in (160, 320):  # from 33 files in a scan on, Spark lists them in a job too
        folder = tmp_path / str(count)
        land_files(folder, count, KINDS)
        scan = lambda: scan_prefix(spark, str(folder), str(folder), BRONZE_PRICES, landed=True)  # noqa: B023, E731
        df, n = jobs_of(spark, scan)
        jobs.append(n)
        rows = {(r.ticker, r.close, str(r.date.date()), r.volume, r.open) for r in df.collect()}
        assert rows == {
            (f"t{i}", float(i), "2024-01-02", {2: 1, 3: 7}.get(i % 4), 1.0 if i % 4 == 3 else None) for i in range(count)
        }
    assert abs(jobs[0] - jobs[1]) <= 3  # adaptive stages come and go
    groups = census.groups_by_schema(census.file_census(spark, str(folder)), spark.read)
    assert sorted(len(files) for _, files in groups) == [80, 80, 160]  # a column more is no conflict


def test_accounts_of_whole_partial_and_skipped_files(spark, tmp_path):
    folder = tmp_path / "a b+c%20d"
    land_files(folder, 6, KINDS[:1])
    many = pa.table({"ticker": ["x"] * 50_000, "close": np.random.default_rng(0).random(50_000), "date": pa.array([dt.datetime(2024, 1, 2)] * 50_000, pa.timestamp("us"))})
    pq.write_table(many, folder / "big.parquet", row_group_size=10_000, compression="none", use_dictionary=False)
    raw = bytearray((folder / "big.parquet").read_bytes())
    at = pq.ParquetFile(folder / "big.parquet").metadata.row_group(2).column(1).data_page_offset
    raw[at:at + 200] = b"\xff" * 200  # the footer stays whole
    (folder / "big.parquet").write_bytes(raw)
    (folder / "none.parquet").write_bytes(b"")
    (folder / "text.parquet").write_bytes(b"no columns")
    pq.write_table(many.slice(0, 0), folder / "rowless.parquet")
    found = census.file_census(spark, str(folder))
    rows = scan_prefix(spark, str(folder), str(folder), BRONZE_PRICES, True, True, census=found, file_column="source_file")
    assert rows.columns == [*BRONZE_PRICES.names, "source_file"]
    rows = materialize(rows, "copy")
    accounts = {os.path.basename(r.path): r for r in census.file_accounts(found, rows).collect()}
    assert len(accounts) == 10
    assert {k for k, r in accounts.items() if r.status == "read"} == {*(f"f{i:04d}.parquet" for i in range(6)), "rowless.parquet"}
    assert {k for k, r in accounts.items() if r.status == "skipped"} == {"none.parquet", "text.parquet"}
    assert accounts["big.parquet"].status == "partial" and accounts["big.parquet"].rows_read < accounts["big.parquet"].rows_expected == 50_000
    totals = census.account_totals(census.file_accounts(found, rows)).first()
    assert (totals.files_found, totals.files_read, totals.files_partial, totals.files_skipped) == (10, 7, 1, 2)
    assert totals.rows_lost == 50_000 - accounts["big.parquet"].rows_read
    with pytest.raises(ValueError, match="cannot be read.*none.parquet"):
        scan_prefix(spark, str(folder), str(folder), BRONZE_PRICES, landed=True, census=found)


def test_stage_counts_of_one_pass(spark):
    df = spark.range(100)
    out, seen = quality.staged(df, [("even", lambda d: d.where("id % 2 = 0")), ("small", lambda d: d.where("id < 10")), ("none", lambda d: d.where("id < 0"))])
    assert out.count() == 0
    assert [tuple(r)[1:] for r in quality.stage_report(spark, seen).orderBy("position").collect()] == [
        ("even", 100, 50, 50), ("small", 50, 5, 45), ("none", 5, 0, 5)
    ]
