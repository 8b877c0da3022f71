"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from apothecary.plans import registry
from tests.conftest import SMALL

TABLES = sorted(f.removesuffix(".parquet") for f in os.listdir(SMALL) if f.endswith(".parquet"))
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value.item() if hasattr(value, "item") else value


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    want = [tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()]
    assert ordered(got) == ordered(want)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)


def test_flagship(spark):
    df = registry.flagship(spark, SMALL)
    assert df.columns == ["drug_a", "drug_b", "report_count", "death_count", "hosp_count", "max_severity"]
