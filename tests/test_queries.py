"""Every query of the catalog against DuckDB, over the smallest tables."""

import duckdb
import pytest

from tidemark.plans import catalog
from tidemark.plans.proxy import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_query(spark, db, name):
    df, want = catalog.QUERIES[name](spark, SF), db.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    order = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
