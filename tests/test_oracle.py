"""Every query that SQL expresses, against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from lumenframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"experiment_run"}))
def test_other_queries_repeat(spark, sf, name):
    first, again = (registry.QUERIES[name](spark, sf).toPandas() for _ in range(2))
    cols = sorted(first.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (first, again))
    pd.testing.assert_frame_equal(a, b)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 5
