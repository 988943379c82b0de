"""The queries that SQL can express, against that SQL on whole tables."""

import duckdb
import pytest

from oddsloom.llm.queries import oracle_sql, queries

TABLES = ("documents", "embeddings", "conversations")


def rows_of(frame_columns, rows):
    order = sorted(range(len(frame_columns)), key=lambda i: frame_columns[i])
    return sorted(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(oracle_sql()[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    df = queries()[name](spark, sf)
    assert rows_of(df.columns, df.collect()) == want and want
