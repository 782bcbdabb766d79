"""Every query with SQL gives what the SQL gives in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from spanlake import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    values = df.astype(object).where(df.notna(), None).itertuples(index=False)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else "" if v is None or v is pd.NaT else str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, sql, name):
    got = plans.queries()[name](spark, sf_dir).toPandas()
    want = sql.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert set(plans.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
