"""Queries with SQL twins equal DuckDB on the smallest tables; all queries run."""
import duckdb
import pytest

from eventide.llm.queries import SQL, Q

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _sorted(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = Q[name](spark, SF)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _sorted(df.columns, df.collect()) == _sorted(rel.columns, rel.fetchall())
