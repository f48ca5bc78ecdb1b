"""The corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, r = queries.queries()[name](spark, sf), con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(row[c] for c in columns)) for row in df.collect()) == sorted(map(repr, r.fetchall()))
