"""Every query with SQL gives the same rows as DuckDB on the smallest tables, if they are there."""

from pathlib import Path

import pytest

from inkwell.plans import registry

DIR = Path("/root/testdata/sf0.001")
TABLES = ["documents", "labels", "pages", "conversations", "events", "benchmark"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DIR.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def lines(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, str(DIR)).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert lines(got) == lines(want)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
