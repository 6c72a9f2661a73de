"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from docloom.plans import answer_queries, registry  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and np.isnan(x):
        return "-"
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(y) for y in x]
    if isinstance(x, (float, np.floating)):
        return f"{x:.9g}"
    return str(x)


def values(df):
    return sorted([plain(x) for x in row] for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
