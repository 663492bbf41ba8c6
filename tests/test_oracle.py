"""Every catalogue query against its SQL, value by value."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as spark_entry

from sensevec.catalog.oracle import all_oracles
from sensevec.catalog.queries import all_queries

QUERIES = all_queries()
ORACLES = all_oracles()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for name in df.columns:
        if df[name].dtype.kind in "iu":
            df[name] = df[name].astype("int64")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_oracles_belong_to_queries():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, folder, name):
    found = ordered(QUERIES[name](spark, folder).toArrow().to_pandas())
    wanted = ordered(duck.execute(ORACLES[name]).df())
    assert len(found) > 0
    pd.testing.assert_frame_equal(found, wanted, check_dtype=False, rtol=0, atol=1.5e-5)


def test_all_are_registered():
    assert set(QUERIES) <= set(spark_entry.queries())
    assert set(ORACLES) <= set(spark_entry.oracle_sql())


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
