"""The corpus queries that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest

from cairn.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    wanted = con.execute(q.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    found = q.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(wanted.fetchall())
