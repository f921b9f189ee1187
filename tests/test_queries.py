"""Every reference query against its SQL in DuckDB, and the contract of __spark_entry__."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from sparkfolio import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([cell(x) for x in v])
    if isinstance(v, (bool, str)):
        return v
    return round(float(v), 6)


def table(df):
    df = df[sorted(df.columns)]
    rows = [tuple(cell(v) for v in r) for r in df.itertuples(index=False)]
    return list(df.columns), sorted(rows, key=lambda r: tuple((x is not None, isinstance(x, str), x) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    got, want = table(registry.queries()[name](spark, sf_dir).toPandas()), table(con.execute(registry.oracle_sql()[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for x, y in zip(got[1], want[1]):
        assert all(u == v or isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=2e-6) for u, v in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_interval_joins_deal_large_input_to_more_tasks(spark, sf_dir, monkeypatch):
    """The same pairs, from as many tasks as the stored sizes ask for."""
    from sparkfolio.operators import joins
    from sparkfolio.queries import market

    want = sorted(map(tuple, market.j09(spark, sf_dir).collect()))
    monkeypatch.setattr(joins, "TASK_BYTES", 2000)
    x = market.j09(spark, sf_dir)
    assert x.rdd.getNumPartitions() > 20 and sorted(map(tuple, x.collect())) == want
