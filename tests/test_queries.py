"""Every registered query runs, and those with SQL give the same rows as DuckDB on the smallest tables."""

import datetime
import math
import os

import pytest

from corpusmill.plans import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF_DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF_DIR}/{f}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    x = float(v)
    return "nan" if math.isnan(x) else f"{x:.6g}"


SAMPLE = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = duck.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_queries_without_sql_run(spark, name):
    assert registry.queries()[name](spark, SF_DIR).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "pass_rate" in df.columns
