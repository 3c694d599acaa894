"""The registered queries against their SQL, and what each promises by itself."""

import duckdb
import pytest

from quernstone.llm import queries

@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = queries.QUERIES[name](spark, d)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want, key=str)
