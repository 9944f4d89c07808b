import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tideline.workload.oracle import ORACLE
from tideline.workload.queries import QUERIES
from tools.check_oracle import TABLES, compare

NAMES = list(QUERIES)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_all_are_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_entry_schema(spark, sf_dir):
    df = entry(spark)
    assert df.columns == ["series", "date", "close", "ret", "vol_7d", "vol_7d_annualized"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    from conftest import SF_DIR

    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, duck, plan, name):
    df = QUERIES[name](spark, sf_dir)
    assert compare(df, duck.sql(ORACLE[name])) == []
    text = plan(df)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas", text)
    if name != "performance_rank":  # orders one row per value bucket, see quality._ranked
        assert not re.search(r"Window.*\n[^\n]*Sort[^\n]*\n[^\n]*SinglePartition", text)
