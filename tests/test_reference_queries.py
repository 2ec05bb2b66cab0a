"""Each registered query of the graph engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from graphloom.plans import more
from graphloom.plans import queries as plans

QUERIES, ORACLE_SQL = plans.QUERIES | more.QUERIES, plans.ORACLE_SQL | more.ORACLE_SQL
SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(list(v) if isinstance(v, tuple) else v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) == len(plans.QUERIES) + len(more.QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), columns)


def test_whole_runs_have_every_customer(spark):
    """More customers a run than the 700 that folded ids allow."""
    sf = "/root/testdata/sf0.1"
    orders = duckdb.connect().execute(f"select count(distinct o_custkey) from read_parquet('{sf}/orders.parquet') group by o_orderpriority, year(o_orderdate)").fetchall()
    found = [r.entities for r in plans.QUERIES["graph_structure_whole"](spark, sf).collect()]
    assert sorted(found) == sorted(n for (n,) in orders) and max(found) > 700
