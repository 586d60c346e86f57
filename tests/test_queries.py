"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    if name in entry.oracle_sql():
        rel = sql.sql(entry.oracle_sql()[name])
        assert sorted(rel.columns) == cols
        assert mine == sorted(tuple(plain(v) for v in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
