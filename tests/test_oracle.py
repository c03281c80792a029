"""Every query that SQL can express gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark import queries as core
from tidemark.sources.tables import TABLES

SF = os.environ.get("ORACLE_SF", "sf0.001")


def plain(value):
    if hasattr(value, "replace") and hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return round(value, 9) + 0.0 if isinstance(value, float) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    from tests.conftest import TESTDATA

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{TESTDATA}/{SF}/{name}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    from tests.conftest import TESTDATA

    got = core.queries()[name](spark, f"{TESTDATA}/{SF}")
    found = duck.execute(core.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    expected, actual = rows_of(columns, found.fetchall()), rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert len(actual) == len(expected)
    wrong = [(a, b) for a, b in zip(actual, expected) if a != b]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", ["threshold_listing"])
def test_listings_come_in_the_order_of_the_sql(spark, duck, name):
    from tests.conftest import TESTDATA

    got = core.queries()[name](spark, f"{TESTDATA}/{SF}")
    found = duck.execute(core.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert [tuple(map(plain, r)) for r in got.select(columns).collect()] == [tuple(map(plain, r)) for r in found.fetchall()]
