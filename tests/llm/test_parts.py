"""Columns of the operators' queries that SQL can express."""

import duckdb
import pytest

from folioforge.llm import queries
from test_queries import TABLES


@pytest.mark.parametrize("name", sorted(queries.PARTS))
def test_sql_of_parts(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, found = queries.PARTS[name](spark, sf), con.sql(queries.PART_ORACLES[name])
    show = lambda rows, names: sorted(str([r[i] for i in sorted(range(len(names)), key=names.__getitem__)]) for r in rows)
    assert show(df.collect(), df.columns) == show(found.fetchall(), list(found.columns))
