"""Every analytics query against its SQL in DuckDB on the smallest tables; those without SQL must give rows."""

import os

import duckdb
import pytest

from helixflow.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got and len(set(df.columns)) == len(df.columns)
        return
    rel = duck.execute(sql)
    assert table(df.columns, got) == table([c[0] for c in rel.description], rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
