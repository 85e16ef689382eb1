"""Every registered ledger query against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from tallyspring.plans.ledger import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 9) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = db.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: tuple(map(repr, row))
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
