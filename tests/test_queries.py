"""Every registered panel query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from pelagos.plans import cleaning_queries, derived_queries, factor_queries, fold_queries, queries, research_queries, risk_queries, signal_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return float(f"{float(value):.8g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def table(rows):
    return sorted(repr(tuple(plain(v) for v in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = found.select(*columns).collect()
    if name not in queries.ORACLE_SQL:
        assert len(rows) > 0
        return
    wanted = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    assert table(rows) == table(wanted.select(*(f'"{c}"' for c in columns)).fetchall())
