"""Every registered query of the conversion against its SQL on the small tables."""

import decimal

import duckdb
import pytest

from folioforge import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: f"{float(x):.9g}" if isinstance(x, (float, decimal.Decimal)) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    if name in catalogue.ORACLES:
        found = duck.sql(catalogue.ORACLES[name])
        assert canon(rows, df.columns) == canon(found.fetchall(), list(found.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
