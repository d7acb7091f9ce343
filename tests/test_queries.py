"""Every registered query against its SQL, on the smallest test tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from headwind.plans.catalogue import QUERIES
from headwind.plans.oracles import oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracles())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("NestedLoop", "Cartesian", "Python", "Pandas", "Arrow"))
