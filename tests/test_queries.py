"""Every registered query of the engine against its SQL in DuckDB, and plans worth keeping."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quernstone.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLE_SQL[name]})")
    assert sorted(c[0] for c in want.description) == cols
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want.fetchall(), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    found = plan(catalogue.QUERIES["pk_lookup"](spark, sf_dir))
    assert "EqualTo(o_orderkey,5)" in found and "Exchange" not in found
    found = plan(catalogue.flagship(spark, sf_dir))
    assert "EqualTo(c_mktsegment,BUILDING)" in found and "o_orderpriority" not in found
    found = plan(catalogue.QUERIES["join_where_right"](spark, sf_dir))
    assert "LeftOuter" not in found and "EqualTo(n_name,FRANCE)" in found
    assert "Python" not in "".join(plan(q(spark, sf_dir)) for n, q in catalogue.QUERIES.items() if n.startswith(("update", "delete", "cmp")))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
