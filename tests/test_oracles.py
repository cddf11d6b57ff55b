"""Every query with oracle SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from lectern import adapters, registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in adapters.TABLES:
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.5f}".replace("-0.00000", "0.00000")
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_duckdb(spark, duck, key):
    frame = QUERIES[key](spark, SF)
    names = sorted(frame.columns)
    found = sorted(tuple(plain(row[n]) for n in names) for row in frame.collect())
    relation = duck.sql(ORACLES[key])
    assert sorted(relation.columns) == names
    order = [relation.columns.index(n) for n in names]
    assert found == sorted(tuple(plain(row[k]) for k in order) for row in relation.fetchall())


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, key):
    assert QUERIES[key](spark, SF).count() > 0
