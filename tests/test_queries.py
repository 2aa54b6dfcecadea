"""Every query of the engine against its SQL."""

import math
import os

import duckdb
import pytest

from tessera import queries, source_queries  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([normal(r[c]) for c in columns]) for r in df.collect())
    cur = db.execute(queries.SQL[name])
    given = [c[0] for c in cur.description]
    assert sorted(given) == columns
    want = sorted(repr([normal(r[given.index(c)]) for c in columns]) for r in cur.fetchall())
    assert got == want


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_the_scan(spark):
    from tessera import Query

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    q = Query.over(spark.read.parquet(f"{DATA}/orders.parquet"))
    text = plan(q.in_("o_orderstatus", ["F", "O"]).greater_than("o_totalprice", 1e5).date_after("o_orderdate", "1996-01-01").not_equals("o_orderpriority", "1-URGENT").out().to_df().select("o_orderkey"))
    pushed = text[text.index("PushedFilters") :]
    for part in ("In(o_orderstatus", "GreaterThan(o_totalprice", "GreaterThan(o_orderdate", "Not(EqualNullSafe(o_orderpriority"):
        assert part in pushed
    assert "o_custkey" not in pushed[pushed.index("ReadSchema") :].split("\n")[0]
    top = plan(q.out().order_by("o_totalprice", "desc").limit(5).to_df())
    assert "TakeOrderedAndProject" in top
