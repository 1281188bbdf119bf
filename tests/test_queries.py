"""Every query against its SQL on the smallest data, and the shape of some plans."""

import glob
import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from webspark import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if isinstance(v, (date, datetime)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    got = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == Counter(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() >= 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_is_taken_before_the_shuffle(spark):
    assert "TakeOrderedAndProject" in plan(plans.QUERIES["frontier_order"](spark, DATA))
    assert "WindowGroupLimit" in plan(plans.QUERIES["link_keyword_topk"](spark, DATA))


def test_scans_read_only_what_they_need(spark):
    text = plan(plans.QUERIES["link_stats"](spark, DATA))
    assert "ReadSchema: struct<fetch_id:bigint,url:string,is_internal:boolean>" in text
    assert "IsNotNull(text)" in plan(plans.QUERIES["exact_dups"](spark, DATA))
