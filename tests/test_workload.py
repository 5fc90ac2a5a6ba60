"""Every registered query of the engine against its SQL, as whole multisets."""

import datetime
import decimal
import os

import duckdb
import pytest

from trellis import workload

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return None if v != v else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(workload.queries()))
def test_query(name, spark, sf_dir, db):
    df = workload.queries()[name](spark, sf_dir)
    got = df.collect()
    sql = workload.oracle_sql().get(name)
    if sql is None:
        return
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = [df.columns.index(n) for n in names]
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr) == want


def test_filters_reach_the_scan(spark, sf_dir):
    plan = workload.engine(spark, sf_dir).explain("SELECT ?o ?t WHERE { ?o v:orderDate ?d ; v:totalPrice ?t ; v:orderStatus 'F' FILTER(?d >= '1995-01-01T00:00:00'^^xsd:dateTime) }", "plan")
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_orderpriority" not in plan
