"""Every registered query against its check query on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.check_oracle import TABLES, compare

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    out = compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert out.startswith(("ok", "rows-only")), out


def test_entry(spark):
    assert entry.entry(spark).count() > 0
