"""Every registered query against its SQL on the smallest tables, and what the plans must not contain."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from check_results import TABLES, rows_of
from curalens.plans.registry import all_queries, all_sql

BASE = "/root/testdata/sf0.001"
PLANS, SQL = all_queries(), all_sql()
PYTHON_ALLOWED = {"extract_text", "image_urls", "listing_candidates", "listing_intake", "listing_stats"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{BASE}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, name):
    df = PLANS[name](spark, BASE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    if name not in PYTHON_ALLOWED:
        assert not re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroups", plan)
    got = rows_of(df.columns, df.collect())
    if name in SQL:
        cursor = duck.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(PLANS) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_filters_and_columns_reach_the_scan(spark):
    plan = PLANS["published_between"](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan or "PushedFilters: [IsNotNull" in plan
    plan = PLANS["count_by_status"](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
