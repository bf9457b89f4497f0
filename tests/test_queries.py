"""Every query with SQL gives the rows that DuckDB gives; on the smallest tables."""

import duckdb
import pytest

from locusflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(tuple, frame[cols].astype(object).where(frame[cols].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
