"""Every registered dialect query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tabulon import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in queries.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def as_text(rows):
    return sorted([repr(v) for v in row] for row in rows)


@pytest.mark.parametrize("name", queries.CASES)
def test_same_as_oracle(spark, duck, name):
    case = queries.CASES[name]
    df = queries.run(case, spark, DATA)
    want = duck.sql(case.oracle)
    assert df.columns == list(want.columns)
    assert as_text(map(tuple, df.collect())) == as_text(want.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    engine = queries.engine_on(spark, DATA)
    text = plan(engine.query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus != 'F'"))
    assert "GreaterThan(o_totalprice,1000.0)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "o_orderpriority" not in text and "Exchange" not in text
    text = plan(engine.query("SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT 5", ordered=True))
    assert "TakeOrderedAndProject" in text
    text = plan(engine.query("SELECT l_returnflag, SUM(l_quantity) FROM lineitem GROUP BY l_returnflag"))
    assert "partial_sum" in text and "row_index" not in text
